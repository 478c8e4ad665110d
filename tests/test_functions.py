from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from tierflow.functions import casts, names, privacy


@pytest.mark.parametrize(
    "text, as_int, as_decimal",
    [
        ("12", 12, Decimal("12.00")),
        (" 12 ", 12, Decimal("12.00")),
        ("12.7", 12, Decimal("12.70")),
        ("-12.7", -12, Decimal("-12.70")),
        (".5", 0, Decimal("0.50")),
        ("abc", None, None),
        ("1e3", None, Decimal("1000.00")),
        ("3000000000", None, None),
        ("$5.00", None, None),
        ("9.995", 9, Decimal("10.00")),
        ("99999999.999", 99999999, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_casts_of_text(spark, text, as_int, as_decimal):
    df = spark.createDataFrame([(text,)], "s string")
    row = df.select(
        casts.lenient_cast(F.col("s"), T.StringType(), T.IntegerType()),
        casts.lenient_cast(F.col("s"), T.StringType(), T.DecimalType(10, 2)),
    ).first()
    assert tuple(row) == (as_int, as_decimal)


def test_casts_of_numbers_give_null_on_overflow(spark):
    df = spark.createDataFrame([(3_000_000_000, 3e9, float("nan"), 12.7)], "l long, d double, n double, f double")
    row = df.select(
        casts.lenient_cast(F.col("l"), T.LongType(), T.IntegerType()),
        casts.lenient_cast(F.col("d"), T.DoubleType(), T.IntegerType()),
        casts.lenient_cast(F.col("n"), T.DoubleType(), T.IntegerType()),
        casts.lenient_cast(F.col("f"), T.DoubleType(), T.IntegerType()),
    ).first()
    assert tuple(row) == (None, None, None, 12)


def test_long_keys_keep_their_digits(spark):
    df = spark.createDataFrame([("3000000000",)], "s string")
    assert df.select(casts.lenient_int(F.col("s"), T.LongType())).first()[0] == 3_000_000_000


def test_normalized_names():
    assert names.normalized_names(["ID", "Room Type", "host-name", "hostName", "a.b"]) == [
        "id", "room_type", "host_name", "hostname", "a.b"
    ]


def test_colliding_names():
    with pytest.raises(ValueError, match="a_b"):
        names.normalized_names(["A b", "a-b"])
    assert names.normalized_names(["A b", "a-b", "a_b_2"], "suffix") == ["a_b", "a_b_3", "a_b_2"]


@given(st.lists(st.text("aB -_.é", min_size=1, max_size=6), min_size=1, max_size=6, unique=True))
@settings(max_examples=200, deadline=None)
def test_normalisation_is_idempotent_and_unique(raw):
    once = names.normalized_names(raw, "suffix")
    assert len(set(once)) == len(raw)
    assert names.normalized_names(once) == once


def test_paths():
    assert names.bucket_path("lake", "a/b") == "s3a://lake/a/b"
    assert names.bucket_path("file:///x", "a/b") == "file:///x/a/b"
    assert names.raw_glob("p", "api", "posts", "20240131", "json") == "p/api/posts/*20240131.json*"
    assert names.raw_glob("p", "csv", "nyc", "20240131", "csv", compressed=False) == "p/csv/nyc/*20240131.csv"
    assert names.bronze_dir("p", "csv", "nyc", "20240131") == "p/csv/nyc/20240131/"
    assert names.raw_key("p", "api", "posts", "dom", "20240131", "json") == "p/api/posts/dom_api_posts_20240131.json"
    assert names.raw_key("", "api", "posts", "dom", "20240131", "csv.gz") == "api/posts/dom_api_posts_20240131.csv.gz"


def test_masking(spark):
    df = spark.createDataFrame([("Ana-12 é",)], "s string")
    assert df.select(privacy.mask_text(F.col("s"))).first()[0] == "Xxx-nn x"


@pytest.mark.parametrize(
    "text, redacted",
    [
        ("write to a.b+c@mail.example.org now", "write to <email> now"),
        ("no address @ here", "no address @ here"),
        ("a@b.co-x@y.org", "<email><email>"),
        ("call 1234567 or 12345", "call <number> or 12345"),
        ("x" * 50_000 + " me@example.com", "x" * 50_000 + " <email>"),
    ],
)
def test_redaction(spark, text, redacted):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(privacy.redact(F.col("s"))).first()[0] == redacted
