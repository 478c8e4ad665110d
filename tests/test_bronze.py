from __future__ import annotations

import json
from dataclasses import replace
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import types as T

from tierflow.operators import quality, rules
from tierflow.plans import bronze
from tierflow.specs import LISTINGS, NYC, EntitySpec

NYC_CSV = """id,name,host_id,host_name,neighbourhood_group,neighbourhood,latitude,longitude,Room Type,price,minimum_nights,number_of_reviews,calculated_host_listings_count,availability_365
1, Loft ,10,Ana,Manhattan,SoHo,40.72,-74.0,Entire home/apt,150,3,9,1,365
1,Copy,10,Ana,Manhattan,SoHo,40.72,-74.0,Entire home/apt,0,3,9,1,365
2,"Room, sunny",11, Bob,Bronx,Fordham,40.4,-73.7,Private room,$80,1,0,1,10
3,Far,12,Cy,Bronx,Fordham,42.0,-73.9,Private room,80,1,0,1,10
4,Edge,12,Cy,Bronx,Fordham,40.4,-74.3,Private room,79.995,1.9,0,1,10
,No id,12,Cy,Bronx,Fordham,40.5,-73.9,Private room,80,1,0,1,10
"""


def test_nyc(spark, tmp_path):
    raw = tmp_path / "lake" / "p" / "csv" / "nyc"
    raw.mkdir(parents=True)
    (raw / "dom_csv_nyc_20240131.csv").write_text(NYC_CSV)
    (raw / "dom_csv_nyc_20240130.csv").write_text("id\n99\n")
    lake, out = f"file://{tmp_path}/lake", f"file://{tmp_path}/out"
    spec = replace(NYC, order=("-price",))
    run = bronze.run_bronze_from_lake(spark, spec, lake, out, "p", "20240131")
    written = spark.read.parquet(f"{out}/p/csv/nyc/20240131/")
    assert run.rows == 2 and run.raw_rows == 6 and run.dropped == 4
    got = {r["id"]: r for r in written.collect()}
    assert set(got) == {1, 4}
    assert got[1]["name"] == "Loft" and got[1]["room_type"] == "Entire home/apt"
    assert got[1]["price"] == Decimal("150.00") and got[4]["price"] == Decimal("80.00")
    assert got[4]["minimum_nights"] == 1
    assert got[1]["_processing_date"] == "20240131"
    assert got[1]["_source_file"].endswith("dom_csv_nyc_20240131.csv")
    assert len({r["_ingestion_timestamp"] for r in got.values()}) == 1
    types = dict(written.dtypes)
    assert (types["id"], types["host_id"], types["latitude"], types["price"]) == ("bigint", "bigint", "double", "decimal(10,2)")
    assert {r["column"] for r in run.profile.collect()} == set(NYC.profile)

    report = bronze.validate_bronze(spark, out, "nyc", "p", "20240131", source="csv").first()
    assert (report["status"], report["bronze_count"], report["null_ids"], report["duplicate_count"]) == ("SUCCESS", 2, 0, 0)
    text = [r["value"] for r in spark.read.text(f"{out}/reports/csv_nyc_validation_20240131.txt").collect()]
    stored = json.loads(text[0])
    assert len(text) == 1 and stored["status"] == "SUCCESS"
    assert json.loads(stored["bronze_schema"])["type"] == "struct"


def test_rerun_replaces_its_output(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    spec, target = EntitySpec("posts"), str(tmp_path / "out")
    for _ in range(2):
        run = bronze.run_bronze(spark, spec, str(tmp_path / "a.json"), target, "20240131")
    assert run.rows == 2 and spark.read.parquet(target).count() == 2


def test_empty_input_writes_nothing(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    schema = T.StructType([T.StructField("id", T.LongType())])
    run = bronze.run_bronze(spark, EntitySpec("posts", schema=schema), str(tmp_path / "a.json"), str(tmp_path / "out"), "20240131")
    assert run.rows == 0 and not (tmp_path / "out").exists()


def test_listings_wrapper_and_plain(spark, tmp_path):
    wrapped = {"products": [
        {"id": 1, "title": " A ", "price": 9.995, "Dim-X": {"Inner Y": 1}},
        {"id": 1, "title": "A", "price": 1.0}, {"id": None, "title": "none"}, {"id": 2, "title": "B"}], "total": 4}
    (tmp_path / "w.json").write_text(json.dumps([wrapped]))
    (tmp_path / "p.json").write_text(json.dumps(wrapped["products"]))
    spec = replace(LISTINGS, order=("-price",))
    for name in ("w", "p"):
        run = bronze.run_bronze(spark, spec, str(tmp_path / f"{name}.json"), str(tmp_path / name), "20240131")
        got = {r["id"]: r for r in spark.read.parquet(run.path).collect()}
        assert run.raw_rows == 4 and set(got) == {1, 2}
        assert got[1]["title"] == "A" and got[1]["price"] == Decimal("10.00") and got[2]["price"] is None
        # Nested fields keep their names.
        assert got[1]["dim_x"]["Inner Y"] == 1
        assert got[1]["_source_file"].endswith(f"{name}.json")


def test_required_columns(spark):
    with pytest.raises(ValueError, match="minimum_nights"):
        bronze.to_bronze(spark.createDataFrame([(1, 2.0)], "id int, price double"), NYC, "20240131")


def test_dedup_first_can_lose_a_key(spark):
    df = spark.createDataFrame([(1, 0.0, 1), (1, 5.0, 2), (2, 7.0, 1)], "id int, price double, seq int")
    spec = EntitySpec("x", positives=("price",), order=("seq",))
    assert sorted(r["id"] for r in bronze.to_bronze(df, spec, "d").collect()) == [1, 2]
    assert [r["id"] for r in bronze.to_bronze(df, spec, "d", dedup_first=True).collect()] == [2]


def test_dedup_limits_each_partition_before_the_shuffle(spark):
    plan = rules.keep_first(spark.range(10).selectExpr("id % 2 as k", "id"), ["k"], ["id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "double(id) as price", "id as other").write.parquet(str(tmp_path / "t"))
    df = bronze.to_bronze(spark.read.parquet(str(tmp_path / "t")), EntitySpec("x", positives=("price",)), "d")
    text = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(price,0.0)" in text and "IsNotNull(id)" in text


def test_keep_first_without_keys_equal_rows_and_maps(spark, rows):
    df = spark.sql("select 1 as id, map('a', 1) as m union all select 1, map('a', 1) union all select null, map('b', 2)")
    assert rules.keep_first(df, ["id"]).count() == 2


ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 3)), min_size=1, max_size=12)


@given(ROWS)
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_dedup_is_idempotent(spark, data):
    df = spark.createDataFrame(data, "id int, v int")
    once = rules.keep_first(df, ["id"], ["-v"])
    twice = rules.keep_first(once, ["id"], ["-v"])
    want = {}
    for key, value in data:
        want[key] = max(value, want.get(key, value))
    assert {tuple(r) for r in once.collect()} == set(want.items())
    assert {tuple(r) for r in twice.collect()} == set(want.items())


def test_report_of_incomplete_tables(spark):
    df = spark.createDataFrame([(1,), (None,), (None,), (1,)], "id int")
    report = quality.quality_report(df, "x", "d").first()
    assert report["status"] == "WARNING" and report["null_ids"] == 2
    # Nulls are one more value among the distinct ones.
    assert report["duplicate_count"] == 2
    assert report["missing_audit_fields"] == list(rules.AUDIT_COLUMNS)
    keyless = rules.audited(spark.createDataFrame([("a",)], "x string"), "d")
    report = quality.quality_report(keyless, "x", "d").first()
    assert report["status"] == "SUCCESS" and report["null_ids"] is None
    empty = quality.quality_report(keyless.limit(0), "x", "d").first()
    assert empty["status"] == "WARNING" and empty["bronze_count"] == 0
    failed = quality.error_report(spark, "x", "d", RuntimeError("gone"))
    assert failed.dtypes == quality.quality_report(df, "x", "d").dtypes
    assert (failed.first()["status"], failed.first()["error"], failed.first()["bronze_count"]) == ("ERROR", "gone", None)


def test_validation_of_a_missing_table(spark, tmp_path):
    report = bronze.validate_bronze(spark, f"file://{tmp_path}", "x", "p", "20240131").first()
    assert report["status"] == "ERROR" and "PATH_NOT_FOUND" in report["error"]
    stored = [r["value"] for r in spark.read.text(f"{tmp_path}/reports/api_x_validation_20240131.txt").collect()]
    assert json.loads(stored[0])["status"] == "ERROR"
