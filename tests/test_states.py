"""Profiles from merged states, and differences by digests."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import functions as F

from tierflow.operators import difference, quality, sketches


def days(spark, n_days=12, rows_a_day=4000, seed=2):
    draw = random.Random(seed)
    data = [(f"2024-01-{d + 1:02d}", draw.gauss(10 * d, 50), draw.randrange(9000), None if draw.random() < 0.1 else f"w{draw.randrange(3000)}") for d in range(n_days) for _ in range(rows_a_day)]
    return spark.createDataFrame(data, "day string, x double, k bigint, w string")


def test_merged_states_are_a_profile_of_all(spark, tmp_path):
    df, path = days(spark), str(tmp_path / "states")
    for part in ("day <= '2024-01-05'", "day > '2024-01-05'", "day = '2024-01-03'"):
        sketches.add_states(df.where(part), path, "day", ["x", "k", "w"])
    merged = {r["column"]: r for r in sketches.merged_profile(sketches.read_states(spark, path)).collect()}
    exact = df.agg(*(f(c).alias(f"{n}_{c}") for c in "xkw" for n, f in (("count", F.count), ("distinct", F.count_distinct))), F.min("x"), F.max("k"), F.sum("k")).first()
    for c in "xkw":
        assert (merged[c]["rows"], merged[c]["count"]) == (48_000, exact[f"count_{c}"])
        assert abs(merged[c]["n_distinct"] / exact[f"distinct_{c}"] - 1) < sketches.DISTINCT_ERROR
    assert (merged["x"]["min"], merged["k"]["max"], int(merged["k"]["sum"])) == (exact["min(x)"], exact["max(k)"], exact["sum(k)"])
    assert merged["w"]["q50"] is None and merged["w"]["longest"] == 5 and merged["w"]["min"] is None
    values = sorted(r["x"] for r in df.collect())
    for q in (25, 50, 75):
        below = sum(v < merged["x"][f"q{q}"] for v in values) / len(values)
        assert abs(below - q / 100) < sketches.RANK_ERROR


def test_a_new_day_reads_nothing_old(spark, tmp_path):
    df, raw, path = days(spark, 3, 200), str(tmp_path / "raw"), str(tmp_path / "states")
    for d in ("01", "02"):
        part = f"{raw}/{d}"
        df.where(F.col("day") == f"2024-01-{d}").write.parquet(part)
        sketches.add_states(spark.read.parquet(part), path, "day", ["x", "k"])
        shutil.rmtree(part)  # the rows themselves are gone
    sketches.add_states(df.where("day = '2024-01-03'"), path, "day", ["x", "k"])
    by_day = sketches.merged_profile(sketches.read_states(spark, path), by=["day"]).where("column = 'x'")
    assert sorted((str(r["day"]), r["rows"]) for r in by_day.collect()) == [(f"2024-01-0{d}", 200) for d in (1, 2, 3)]
    assert sketches.merged_profile(sketches.read_states(spark, path)).where("column = 'k'").first()["rows"] == 600


def test_states_of_nothing_and_of_nulls(spark):
    empty = days(spark, 1, 3).where("false")
    assert sketches.merged_profile(sketches.profile_states(empty, "day", ["x", "w"])).count() == 0
    nulls = spark.createDataFrame([("d", None, None)], "day string, x double, w string")
    found = {r["column"]: r for r in sketches.merged_profile(sketches.profile_states(nulls, "day", ["x", "w"])).collect()}
    assert (found["x"]["rows"], found["x"]["count"], found["x"]["q50"], found["w"]["n_distinct"]) == (1, 0, None, 0)


KEYED = "a string, b int, v string, w double"


def two_loads(spark):
    draw = random.Random(4)
    before = [(draw.choice("xyz"), i, f"v{i % 7}", float(i)) for i in range(3000)]
    after = [r for r in before if r[1] % 41]
    after = [(a, b, "new", w) if b % 173 == 5 else (a, b, v, None) if b % 211 == 6 else (a, b, v, w) for a, b, v, w in after]
    after += [("n", 10_000 + i, None, None) for i in range(9)] + [after[17]] + [(None, None, "null key", 1.0)]
    return before, after


def expected(before, after):
    from collections import Counter, defaultdict

    sides = [defaultdict(Counter), defaultdict(Counter)]
    for side, rows in zip(sides, (before, after)):
        for r in rows:
            side[r[:2]][r] += 1
    for key in sides[0].keys() | sides[1].keys():
        if sides[0][key] != sides[1][key]:
            yield *key, "removed" if not sides[1][key] else "added" if not sides[0][key] else "changed"


@pytest.mark.parametrize("levels", [1, 4, 6])
def test_differences_are_brute_force(spark, rows, levels):
    before, after = two_loads(spark)
    frames = [spark.createDataFrame(x, KEYED).repartition(n) for x, n in ((before, 5), (after, 2))]
    found = difference.differences(*frames, ["a", "b"], ["v", "w"], levels)
    assert rows(found) == sorted(expected(before, after), key=repr)
    same = difference.differences(frames[0], frames[0].repartition(7), ["a", "b"], ["v", "w"], levels)
    assert same.count() == 0


def test_it_agrees_with_reconciliation(spark):
    before, after = ([r for r in x if r[1] is not None] for x in two_loads(spark))
    after = list(dict.fromkeys(after))
    frames = [spark.createDataFrame(x, KEYED).withColumn("key", F.concat_ws("-", "a", "b")) for x in (before, after)]
    report = quality.reconcile(*frames, "key", ["v", "w"]).first()
    changes = {r["change"]: r["count"] for r in difference.differences(*frames, ["key"], ["v", "w"]).groupBy("change").count().collect()}
    assert changes == {"removed": report["keys_lost"], "added": report["keys_added"], "changed": report["keys_changed"]}


def test_only_ranges_that_differ_are_looked_at(spark):
    before = spark.range(100_000).selectExpr("id AS k", "id % 13 AS v")
    after = before.withColumn("v", F.when(F.col("k") == 777, -1).otherwise(F.col("v")))
    trees = [difference.digest_tree(x, ["k"], ["v"]) for x in (before, after)]
    leaves = difference.differing_leaves(*trees)
    assert leaves.count() == 1
    # Of 65,536 leaves one differs; what is shuffled by key is its rows.
    chosen = difference._leaves(before, ["k"], ["v"], difference.LEVELS).join(leaves.withColumnRenamed("node", "_leaf"), "_leaf", "left_semi")
    assert 1 <= chosen.count() < 20
    found = difference.differences(before, after, ["k"], ["v"], trees=tuple(trees)).collect()
    assert [tuple(r) for r in found] == [(777, "changed")]
    sums = trees[0].groupBy("level").agg(F.sum("n").alias("n"), F.count("*").alias("nodes")).orderBy("level").collect()
    assert [r["n"] for r in sums] == [100_000] * 5 and sums[0]["nodes"] == 1 and sums[1]["nodes"] == 16
