from __future__ import annotations

import itertools
import pathlib
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tierflow.operators import core, history, load, marts, quality, sinks
from tierflow.workspace import durable, shared_root, temporary_tables

QUIET = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# Quality


def consistency(spark, payloads, strict=False):
    df = spark.createDataFrame([(p,) for p in payloads], "p string")
    r = quality.field_consistency(df, "p", strict).first()
    return r["n_objects"], r["n_fields"], r["n_common"], r["n_key_sets"], r["passed"]


def test_field_consistency(spark):
    assert consistency(spark, ['{"a":1,"b":2}', '{"b":1,"a":null}']) == (2, 2, 2, 1, True)
    assert consistency(spark, ['{"a":1,"b":2}', '{"b":1}']) == (2, 2, 1, 2, True)
    assert consistency(spark, ['{"a":1,"b":2}', '{"b":1}'], strict=True)[-1] is False
    assert consistency(spark, ['{"a":1}', '{"b":1}']) == (2, 2, 0, 2, False)
    assert consistency(spark, ['{"a":1}', "[1]", "7", "bad"]) == (1, 1, 1, 1, True)
    assert consistency(spark, ["[1]", "7"]) == (0, 0, 0, 0, False)
    assert consistency(spark, ["{}"]) == (1, 0, 0, 1, False)
    assert consistency(spark, ["{}"], strict=True)[-1] is True
    assert consistency(spark, []) == (0, 0, 0, 0, True)


@given(st.lists(st.sets(st.sampled_from("abcd")), min_size=1, max_size=6))
@QUIET
def test_field_consistency_of_any_records(spark, records):
    payloads = ["{" + ",".join(f'"{k}":1' for k in sorted(r)) + "}" for r in records]
    common, everything = set.intersection(*records), set.union(*records)
    sets = len({frozenset(r) for r in records})
    assert consistency(spark, payloads) == (len(records), len(everything), len(common), sets, bool(common))


def test_validate_records(spark):
    def checks(*payloads):
        df = spark.createDataFrame([(p,) for p in payloads], "p string")
        return {r["check"]: (r["passed"], r["warning"]) for r in quality.validate_records(df, "p").collect()}

    assert checks('{"a":1}')["all"] == (True, False)
    assert checks()["not_empty"] == (False, False) and checks()["all"] == (False, False)
    broken = checks('{"a":1}', '{"a"')
    assert broken["json_valid"] == (False, False) and broken["field_consistency"] == (True, False) and not broken["all"][0]
    assert checks('{"a":1,"b":1,"c":1}', '{"a":1}')["field_consistency"] == (True, True)


def test_reconcile_adds_up(spark):
    raw = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "id int, v string")
    bronze = spark.createDataFrame([(1, "b"), (2, "x"), (9, "n")], "id int, v string")
    r = quality.reconcile(raw, bronze, "id", ["v"]).first().asDict()
    assert (r["raw_rows"], r["bronze_rows"], r["raw_keys"], r["bronze_keys"]) == (5, 3, 3, 3)
    assert (r["keys_lost"], r["keys_added"], r["keys_changed"]) == (1, 1, 1)
    assert r["raw_keys"] - r["keys_lost"] == r["bronze_keys"] - r["keys_added"]


def test_schema_tools(spark):
    old = spark.createDataFrame([(1, "a")], "id int, x string")
    new = spark.createDataFrame([(1, 2.0)], "id bigint, y double")
    assert quality.schema_drift(old, new) == [
        ("type_changed", "id", "int", "bigint"), ("removed", "x", "string", None), ("added", "y", None, "double")
    ]
    assert dict(quality.evolve_union(old, new).dtypes) == {"id": "bigint", "x": "string", "y": "double"}
    assert [tuple(r) for r in quality.schema_table(old).collect()] == [(0, "id", "int", True), (1, "x", "string", True)]
    assert {r["summary"] for r in quality.describe_all(old).collect()} == {"count", "mean", "stddev", "min", "max"}
    assert quality.sample_rows(old, 5).count() == 1


def test_violations(spark):
    child = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (None, 3), (7, 3), (7, 3)], "k int, v int")
    parent = spark.createDataFrame([(1,), (2,)], "p int")
    assert tuple(quality.violations_unique(child, "k").first()) == (2, 4)
    assert tuple(quality.violations_unique(child, "k", "v").first()) == (1, 2)
    assert [tuple(r) for r in quality.violations_not_null(child, ["k", "v"]).collect()] == [("k", 1), ("v", 0)]
    assert tuple(quality.violations_relationship(child, parent, "k", "p").first()) == (1, 2)


# Histories


def change_rows(data):
    return [(i, k, datetime(2024, 1, 1) + timedelta(hours=t), v) for i, (k, t, v) in enumerate(data)]


def changes(spark, data):
    return spark.createDataFrame(change_rows(data), "id int, k int, t timestamp_ntz, v string")


def plain_history(data):
    """Versions by walking every key in order."""
    found = []
    for key in {k for k, _, _ in data if k is not None}:
        rows = sorted((r[2], r[0], r[3]) for r in change_rows(data) if r[1] == key)
        starts = [r for i, r in enumerate(rows) if i == 0 or rows[i - 1][2] != r[2]]
        for i, (t, _, v) in enumerate(starts):
            end = starts[i + 1][0] if i + 1 < len(starts) else None
            found.append((key, v, t, end, end is None))
    return found


CHANGES = st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.integers(0, 9), st.sampled_from("ab")), min_size=1, max_size=25)


@given(CHANGES)
@QUIET
def test_scd2_build(spark, data):
    got = history.scd2_build(changes(spark, data), "k", "v", "t", "id", slices=5)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_history(data), key=repr)


def test_scd2_build_tracks_nulls(spark):
    got = history.scd2_build(changes(spark, [(1, 0, None), (1, 1, None), (1, 2, "a"), (1, 3, None)]), "k", "v", "t", "id")
    assert [r["v"] for r in got.orderBy("valid_from").collect()] == [None, "a", None]


def test_scd2_merge_twice_is_once(spark, rows):
    first, second = [(1, 0, "a"), (2, 0, "a"), (3, 5, "a")], [(1, 3, "b"), (1, 4, "c"), (2, 3, "a"), (3, 4, "z"), (4, 3, "n")]
    known = history.scd2_build(changes(spark, first), "k", "v", "t", "id")
    batch = changes(spark, second)
    once = history.scd2_merge(known, batch, "k", ["v"], "t", "id")
    assert [(r["k"], r["v"], r["is_current"]) for r in once.orderBy("k", "valid_from").collect()] == [
        (1, "a", False), (1, "b", False), (1, "c", True), (2, "a", True), (3, "z", False), (3, "a", True), (4, "n", True)
    ]
    assert rows(history.scd2_merge(once, batch, "k", ["v"], "t", "id")) == rows(once)


@given(CHANGES, st.lists(st.tuples(st.integers(1, 3), st.integers(0, 10)), min_size=1, max_size=15))
@QUIET
def test_scd2_asof(spark, data, wanted):
    dimension = history.scd2_build(changes(spark, data), "k", "v", "t", "id", slices=3)
    start = datetime(2024, 1, 1)
    facts = [(i, k, start + timedelta(hours=h)) for i, (k, h) in enumerate(wanted)]
    frame = spark.createDataFrame(facts, "id int, k int, t timestamp_ntz")
    got = history.scd2_asof(frame, dimension, "k", "t", "id", ["v"], slices=5)
    versions = plain_history(data)
    want = {
        i: next((v for kk, v, a, b, _ in versions if kk == k and a <= t and (b is None or t < b)), None)
        for i, k, t in facts
    }
    assert {r["id"]: r["v"] for r in got.collect()} == want
    assert got.columns == ["id", "k", "t", "v"]


# Core


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_fuzzy_match_finds_every_pair(spark, k):
    rng = random.Random(k)
    names = sorted({"".join(rng.choice("ab c") for _ in range(rng.randrange(1, 6))).strip() or "a" for _ in range(40)})
    clean = sorted({" ".join(n.split()) for n in names})
    df = spark.createDataFrame([("x", n) for n in clean] + [("y", clean[0]), ("x", None)], "block string, name string")
    got = core.fuzzy_match(df, df, "block", "name", k, self_match=True)
    want = {(a, b, edits(a, b)) for a, b in itertools.combinations(clean, 2) if edits(a, b) <= k}
    assert {(r["name_a"], r["name_b"], r["distance"]) for r in got.collect()} == want


def test_fuzzy_match_of_two_sides_counts_rows(spark):
    left = spark.createDataFrame([("x", " Red  Nut"), ("x", "red nut")], "block string, name string")
    right = spark.createDataFrame([("x", "red nuts"), ("x", "red nut"), ("y", "red nut")], "block string, name string")
    got = core.fuzzy_match(left, right, "block", "name", 1)
    assert {(r["name_b"], r["n_a"], r["n_b"], r["distance"], r["similarity"]) for r in got.collect()} == {
        ("red nuts", 2, 1, 1, 0.875), ("red nut", 2, 1, 0, 1.0)
    }


def test_semantic_dedup(spark, rows):
    df = spark.createDataFrame([(3, " A\t b\n"), (1, "a B"), (2, "ab"), (4, None)], "id int, x string")
    assert rows(core.semantic_dedup(df, ["x"], "id")) == [(1, 2), (2, 1), (4, 1)]


def test_clamp_and_conform(spark):
    df = spark.createDataFrame([(-5.0, "es"), (3.0, " EU "), (9.0, None), (None, "??")], "x double, c string")
    assert [r[0] for r in df.select(core.clamp(F.col("x"), 0.0, 5.0)).collect()] == [0.0, 3.0, 5.0, None]
    got = core.conform(df, "c", {"ES": "ESP", "EU": "EUR"}, "N/A", "code").select("code", "code_unmapped")
    assert [tuple(r) for r in got.collect()] == [("ESP", False), ("EUR", False), ("N/A", True), ("N/A", True)]


def test_resolve_identity(spark):
    events = spark.createDataFrame(
        [(1, 10, "a@x"), (2, None, "b@x"), (3, 99, "b@x"), (4, None, None), (5, 99, "zz")], "e int, uid int, mail string"
    )
    people = spark.createDataFrame([(10, "z@x"), (11, "b@x")], "pid int, pmail string")
    got = core.resolve_identity(events, people, "e", ("uid", "pid", "pid"), ("mail", "pmail"))
    assert {(r["e"], r["person"], r["matched_by"]) for r in got.collect()} == {
        (1, 10, "id"), (2, 11, "email"), (3, 11, "email"), (4, None, "none"), (5, None, "none")
    }
    assert got.columns == ["e", "uid", "mail", "person", "matched_by", "ambiguous"]


def test_resolve_identity_keeps_one_row(spark):
    events = spark.createDataFrame([(1, None, "b@x"), (2, 10, None)], "e int, uid int, mail string")
    people = spark.createDataFrame([(10, 12, "b@x"), (11, 11, "b@x"), (10, 13, None)], "pid int, person int, pmail string")
    got = core.resolve_identity(events, people, "e", ("uid", "pid", "person"), ("mail", "pmail"))
    assert {tuple(r)[3:] for r in got.collect()} == {(11, "email", True), (12, "id", True)}


def test_interpolation_and_time_zones(spark):
    df = spark.sql("select 1 as k, date'2024-01-01' as d, 1.0D as v union all select 1, date'2024-01-04', 4.0D")
    got = core.interpolate_days(df, "k", "d", "v").orderBy("d").collect()
    assert [(r["v"], r["interpolated"]) for r in got] == [(1.0, False), (2.0, True), (3.0, True), (4.0, False)]
    local = spark.sql("select timestamp_ntz'2024-07-01 12:00:00' as t")
    assert local.select(core.to_utc(F.col("t"), F.lit("Europe/Madrid"))).first()[0] == datetime(2024, 7, 1, 10)


# Loads


def test_incremental(spark):
    source = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, seq int")
    assert [r["id"] for r in load.incremental(source, source.where("seq = 5"), "seq").collect()] == [2]
    assert load.incremental(source, source.limit(0), "seq").count() == 3


MERGES = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9), st.sampled_from("IUD")), max_size=12)


@given(MERGES, MERGES)
@QUIET
def test_cdc_matches_replay(spark, start, log):
    table = {k: v for k, v, _ in start}
    target = spark.createDataFrame(list(table.items()), "k int, v int")
    changes = spark.createDataFrame([(k, v, op, i) for i, (k, v, op) in enumerate(log)], "k int, v int, op string, seq int")
    for k, v, op in log:
        table.pop(k, None) if op == "D" else table.update({k: v})
    once = load.apply_cdc(target, changes, ["k"], ["-seq"])
    assert dict(map(tuple, once.collect())) == table
    assert dict(map(tuple, load.apply_cdc(once, changes, ["k"], ["-seq"]).collect())) == table


def test_upsert_appends_and_folds_touched_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, v string"
    base = spark.range(1000).select("id", F.lit("a").alias("v"))
    assert load.read_buckets(spark, path, base.schema).count() == 0
    load.upsert_buckets(base, path, ["id"], ["-v"], buckets=16)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "base").rglob("*.parquet")}
    load.upsert_buckets(spark.createDataFrame([(5, "b"), (5000, "c")], schema), path, ["id"], ["-v"])
    # A small batch costs its own size: the base stays as it is until the changes are folded.
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "base").rglob("*.parquet")} == before
    for _ in range(2):
        got = load.read_buckets(spark, path, base.schema)
        assert got.count() == 1001 and got.where("v = 'b'").first()["id"] == 5
        if (tmp_path / "t" / "changes").exists():
            load.fold_buckets(spark, path, base.schema)
    assert len(set(before) - set((tmp_path / "t" / "base").rglob("*.parquet"))) <= 2


def test_upsert_keeps_the_latest_whatever_the_order(spark, tmp_path, rows):
    path, schema = str(tmp_path / "t"), "k string, ts int, v string"
    batches = [[("a", 5, "new"), (None, 1, "n")], [("a", 3, "old"), (None, 1, "n"), ("b", 1, "x")], [("a", 5, "new"), (None, 2, "m")]]
    for batch in batches:
        load.upsert_buckets(spark.createDataFrame(batch, schema), path, ["k"], ["-ts"], buckets=4)
    got = load.read_buckets(spark, path, spark.createDataFrame([], schema).schema)
    assert rows(got) == [("a", 5, "new"), ("b", 1, "x"), (None, 2, "m")]
    with pytest.raises(ValueError, match="was made with"):
        load.upsert_buckets(spark.createDataFrame(batches[0], schema), path, ["k"], ["-ts"], buckets=64)


def test_null_keys_are_one_key(spark, rows):
    target = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")
    changes = spark.createDataFrame([(None, "c", 1)], "k int, v string, seq int")
    once = load.merge_upsert(target, changes, ["k"], ["-seq"])
    assert rows(once) == rows(load.merge_upsert(once, changes, ["k"], ["-seq"])) == [(1, "b"), (None, "c")]


def test_high_water_mark_where_clocks_are_set_back(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        instants = [1730611800, 1730615400, 1730619000]  # 01:30, 01:30 again, 02:30
        source = spark.createDataFrame([(i,) for i in instants], "s long").select(F.timestamp_seconds("s").alias("t"), "s")
        new = load.incremental(source, source.where(F.col("s") <= instants[1]), "t")
        assert [r["s"] for r in new.collect()] == [instants[2]]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_raw_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'x "y", z', None)], "b int, a string, c string")
    path = str(tmp_path / "csv")
    sinks.write_raw_csv(df, path)
    assert spark.read.option("header", True).option("escape", '"').csv(path).first().asDict() == {"a": 'x "y", z', "b": "1", "c": None}
    with pytest.raises(sinks.TargetExists):
        sinks.write_raw_csv(df, path)
    sinks.write_raw_csv(df, path, allow_overwrite=True)
    with pytest.raises(sinks.EmptyInput):
        sinks.write_raw_json(df.limit(0), str(tmp_path / "none"))
    assert not sinks.target_exists(spark, str(tmp_path / "none"))


def test_compact(spark, tmp_path):
    small, big = str(tmp_path / "small"), str(tmp_path / "big")
    spark.range(10_000).selectExpr("0 as k", "id").repartition(20).write.parquet(small)
    files = sinks.compact(spark, small, big, ["k"], target_bytes=sinks.directory_bytes(spark, small) // 3)
    written = [p for p in (tmp_path / "big").glob("*.parquet")]
    # One value fills the table and is still split between the files.
    assert 3 <= files <= 4 and len(written) == files
    assert spark.read.parquet(big).count() == 10_000


def test_expired_partitions_are_removed(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.sql("select id, date_add(date'2024-01-01', cast(id as int)) as d from range(5)")
    sinks.write_partitions(df, path, ["d"])
    assert sinks.expire_partitions(spark, path, "d", "2024-01-03") == ["2024-01-01", "2024-01-02"]
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    assert sinks.expire_partitions(spark, path, "other", "2024-01-03") == []


def test_erase_keeps_rows_without_key(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "u int, x string").write.parquet(str(tmp_path / "t"))
    target, removed = sinks.erase_table(spark, str(tmp_path / "t"), spark.createDataFrame([(1,), (1,)], "u int"), "u")
    assert removed == 2 and sorted(r["x"] for r in spark.read.parquet(target).collect()) == ["b", "c"]


# Marts


def test_efficiency(spark):
    df = spark.createDataFrame([(10, 4.0, 1.0), (10, 0.0, 0.0), (None, 1.0, 1.0)], "s int, l double, d double")
    assert [r[0] for r in df.select(marts.efficiency(F.col("s"), F.col("l"), F.col("d"))).collect()] == [2.0, None, None]


def test_gross_margin_without_revenue(spark):
    df = spark.sql("select 'a' as k, 0.00BD as r, 1.00BD as c")
    assert marts.gross_margin(df, ["k"], F.col("r"), F.col("c"), F.col("c")).first()["gross_margin"] is None


def test_funnel_needs_later_events(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    events = spark.createDataFrame(
        [(1, "view", t(2)), (1, "click", t(1)), (1, "click", t(3)), (1, "buy", t(2)), (2, "view", t(1)), (2, "click", t(1)),
         (3, "click", t(1)), (None, "view", t(1)), (4, "view", t(1)), (4, "click", t(2)), (4, "buy", t(3))],
        "u int, e string, t timestamp_ntz",
    )
    got = marts.funnel(events, "u", "e", "t", ["view", "click", "buy"]).orderBy("step").collect()
    assert [r["n"] for r in got] == [3, 2, 1]


@given(st.lists(st.integers(-400, 400), min_size=1, max_size=30))
@QUIET
def test_sessions(spark, minutes):
    start = datetime(1970, 1, 1)
    times = sorted(start + timedelta(minutes=m) for m in minutes)
    gap = timedelta(minutes=30)
    want, current = [], None
    for at in times:
        if current is None or at >= current[1] + gap:
            current = [at, at, 0]
            want.append(current)
        current[1], current[2] = at, current[2] + 1
    df = spark.createDataFrame([(1, at) for at in times], "u int, t timestamp_ntz")
    got = marts.session_kpis(df, "u", "t", 30).orderBy("session_start").collect()
    assert [(r["session_start"], r["session_end"], r["n_events"]) for r in got] == [(a, b + gap, n) for a, b, n in want]


def test_shared_root_needs_the_setting_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            applicationId = "nowhere"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Cluster)
    Cluster.conf.get = staticmethod(lambda key, default: "hdfs:///shared/")
    assert shared_root(Cluster) == "hdfs:///shared"


def test_temporary_tables_go(spark, tmp_path):
    with temporary_tables(spark):
        kept = durable(spark.range(5))
        path = kept.inputFiles()[0].removeprefix("file://")
        kept.write.parquet(str(tmp_path / "kept"))
    assert not pathlib.Path(path).exists() and spark.read.parquet(str(tmp_path / "kept")).count() == 5


PARTS = st.lists(st.one_of(st.none(), st.text("a|:-1", max_size=3)), min_size=1, max_size=3)


@given(PARTS, PARTS)
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_keys_tell_rows_apart(spark, one, other):
    def key(parts):
        return spark.range(1).select(history.surrogate_key(*(F.lit(p).cast("string") for p in parts))).first()[0]

    assert (key(one) == key(other)) == (one == other)


def test_reconcile_sees_a_null_move(spark):
    raw = spark.createDataFrame([(1, None, "a")], "id int, x string, y string")
    bronze = spark.createDataFrame([(1, "a", None)], "id int, x string, y string")
    assert quality.reconcile(raw, bronze, "id", ["x", "y"]).first()["keys_changed"] == 1


def test_evolve_union_of_changed_types(spark, rows):
    old = spark.createDataFrame([(1, 2, None, "x")], "a bigint, b int, c date, d string")
    new = spark.createDataFrame([("z", 2.5, True, 7)], "a string, b double, c boolean, d int")
    got = quality.evolve_union(old, new)
    assert dict(got.dtypes) == {"a": "string", "b": "double", "c": "string", "d": "string"}
    assert rows(got) == rows(spark.createDataFrame([("1", 2.0, None, "x"), ("z", 2.5, "true", "7")], got.schema))


def test_match_share_of_repeated_truth(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    truth = spark.createDataFrame([(1, "a"), (1, "a"), (1, "z")], "t int, w string")
    assert tuple(quality.match_share(df, truth, "k", "t", "v", "w").first()) == (0.5, 0.5)


def test_star_fact_keeps_facts_without_a_member(spark, rows):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    got = marts.star_fact(facts, [(spark.createDataFrame([("a",), ("a",)], "k string"), "k", "key")])
    found = {r["id"]: r["key"] for r in got.collect()}
    assert len(found) == got.count() == 3 and found[2] == found[3] == "unknown" != found[1]


def test_impute_small_values(spark):
    df = spark.createDataFrame([("g", 0.00002), ("g", 0.00004), ("g", None)], "k string, v double")
    got = core.impute_group_mean(df, ["k"], "v", F.col("v").isNotNull(), digits=None, scale=8)
    assert [r["v"] for r in got.where("v_imputed").collect()] == [pytest.approx(0.00003)]


def test_conform_from_a_table(spark, rows):
    df = spark.createDataFrame([(1, " us "), (2, "xx"), (3, None)], "id int, c string")
    codes = spark.createDataFrame([("US", "USA"), ("us", "USA"), (None, "none")], "code string, standard string")
    got = core.conform(df, "c", codes, "other", "std")
    assert rows(got.select("id", "std", "std_unmapped")) == [(1, "USA", False), (2, "other", True), (3, "other", True)]


def test_fuzzy_match_of_long_names(spark):
    """The parts that are joined do not grow with the length of a name."""
    long = "abcdefghij" * 16
    df = spark.createDataFrame([("x", long), ("x", long[:50] + "Z" + long[51:]), ("x", long[:-1])], "block string, name string")
    got = core.fuzzy_match(df, df, "block", "name", 2, self_match=True)
    assert sorted(r["distance"] for r in got.collect()) == [1, 1, 2]
    assert df.select(F.max(F.size(core.probed_pieces(F.col("name"), 2)))).first()[0] <= 75
