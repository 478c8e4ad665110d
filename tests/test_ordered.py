"""Ordered operators against plain windows, with a key that holds most of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from tierflow.operators import ordered
from tierflow.operators.joins import left_join_spread, with_group_stats

ORDER = ["t", "id"]


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows; key 0 holds two thirds, times repeat, a third of the values is null."""
    rng = random.Random(7)
    rows = []
    for i in range(2000):
        key = 0 if rng.random() < 0.66 else rng.choice([None, *range(1, 40)])
        value = None if rng.random() < 0.33 else rng.randrange(100)
        rows.append((i, key, rng.randrange(200), value))
    return spark.createDataFrame(rows, "id int, k int, t int, v int")


@pytest.fixture(scope="module")
def sliced(skewed):
    return ordered.slice_rows(skewed, ["k"], ORDER, slices=16).cache()


def test_a_hot_key_covers_many_slices(sliced):
    per_slice = [r["count"] for r in sliced.groupBy(ordered.SLICE).count().collect()]
    hot = sliced.where("k = 0").select(ordered.SLICE).distinct().count()
    assert hot >= 8 and max(per_slice) < 2000 / 16 * 2



def test_previous_next_and_last(skewed, sliced, rows):
    w = Window.partitionBy("k").orderBy(*ORDER)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    for got, want in (
        (ordered.previous_value(sliced, ["k"], ORDER, "v", "x"), F.lag("v").over(w)),
        (ordered.next_value(sliced, ["k"], ORDER, "v", "x"), F.lead("v").over(w)),
        (ordered.last_known(sliced, ["k"], ORDER, "v", "x"), F.last("v", ignorenulls=True).over(upto)),
    ):
        assert rows(got.select("id", "x")) == rows(skewed.withColumn("x", want).select("id", "x"))


def test_running_total(skewed, sliced, rows):
    ones = sliced.withColumn("one", F.lit(1))
    got = ordered.running_total(ones, ["k"], ORDER, "one", "rn").select("id", "rn")
    w = Window.partitionBy("k").orderBy(*ORDER)
    assert rows(got) == rows(skewed.select("id", F.row_number().over(w).alias("rn")))


@pytest.mark.parametrize("n, buckets", [(2000, 5), (7, 5), (3, 5), (10, 5), (1, 1)])
def test_ntile(spark, skewed, rows, n, buckets):
    df = skewed.where(F.col("id") < n)
    got = ordered.ntile(df, buckets, [F.desc("t"), F.asc("id")], "b").select("id", "b")
    want = df.select("id", F.ntile(buckets).over(Window.orderBy(F.desc("t"), "id")).alias("b"))
    assert rows(got) == rows(want)


def test_numbered(skewed, rows):
    got = ordered.numbered(skewed, ["t", "id"], "rn", "n", slices=5).select("id", "rn", "n")
    want = skewed.select("id", F.row_number().over(Window.orderBy("t", "id")).alias("rn"), F.lit(2000).alias("n"))
    assert rows(got) == rows(want)


def test_exact_percentiles(skewed):
    got = ordered.exact_percentiles(skewed, ["k"], "v", {"a": 0.0, "q": 0.25, "m": 0.5, "z": 1.0}, slices=16)
    pdf = skewed.toPandas().dropna(subset=["v"])
    pdf["k"] = pdf["k"].fillna(-1)
    want = pdf.groupby("k")["v"].quantile([0.0, 0.25, 0.5, 1.0]).unstack()
    for r in got.collect():
        key = -1 if r["k"] is None else r["k"]
        assert [r["a"], r["q"], r["m"], r["z"]] == pytest.approx(list(want.loc[key]))
    assert got.count() == len(want)


def test_group_stats_include_null_keys(spark, rows):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = with_group_stats(df, ["k"], F.avg("v").alias("m"))
    assert rows(got) == rows(spark.createDataFrame([(None, 1.0, 2.0), (None, 3.0, 2.0), ("a", 5.0, 5.0)], "k string, v double, m double"))


def test_left_join_spread(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 10, F.col("id") % 3).alias("k"))
    right = spark.createDataFrame([(0, "a"), (1, "b")], "rk long, x string")
    got = left_join_spread(left, right, "k", "rk", "id")
    assert got.count() == 1000 and got.where("x is not null").count() == 7


