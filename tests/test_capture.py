from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Row, functions as F, types as T

from tierflow.operators import load
from tierflow.streaming import capture, jobs

SCHEMA = "id bigint, v string, op string, seq int, t timestamp_ntz"
START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def stream_of(spark, folder, part):
    df = spark.createDataFrame(part, SCHEMA)
    df.repartition(3).write.mode("append").parquet(folder)
    return jobs.read_stream(spark, folder, df.schema).drop("_source_file")


def captured(spark, tmp_path, parts, late_by="100 hours"):
    folder, path, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    living = None
    for part in parts:  # every part is a restart of the query
        living = capture.run_capture(stream_of(spark, folder, part), ["id"], ["seq"], "t", late_by, path, state, buckets=4)
    return living


def test_changes_in_any_order_are_the_batch(spark, tmp_path, rows):
    draw = random.Random(3)
    changes = []
    for key in [*range(40), None]:
        for seq in range(draw.randint(1, 6)):
            op = draw.choice("IUUD") if seq else "I"
            changes.append((key, f"{key}-{seq}", op, seq, at(seq)))
    changes += draw.sample(changes, 30)  # repeated ones
    changes += [(7, f"hot {i}", "U", 10 + i, at(3)) for i in range(300)]
    draw.shuffle(changes)
    living = captured(spark, tmp_path, [changes[:150], changes[150:300], changes[300:]])
    empty = spark.createDataFrame([], "id bigint, v string")
    wanted = load.apply_cdc(empty, spark.createDataFrame(changes, SCHEMA), ["id"], ["-seq"])
    assert rows(living.select("id", "v")) == rows(wanted)


def test_older_changes_do_not_reach_the_table(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    out = str(tmp_path / "out")
    with capture._rocksdb(spark):
        for part in ([(1, "new", "U", 5, at(5))], [(1, "old", "U", 4, at(4)), (1, "new", "U", 5, at(5)), (2, "x", "I", None, at(1))], [(2, "y", "U", 0, at(1))]):
            newest = capture.newest_changes(stream_of(spark, folder, part), ["id"], ["seq"], "t", "100 hours")
            got = jobs.run_append(newest, out, state)
    assert sorted(r["v"] for r in got.collect()) == ["new", "x", "y"]


def test_tombstones_go_when_the_watermark_has_passed_them(spark, tmp_path):
    parts = [
        [(1, "a", "I", 0, at(0)), (2, "b", "I", 0, at(0)), (3, "c", "I", 0, at(0))],
        [(1, "a", "D", 2, at(2)), (2, "b", "D", 2, at(30))],
        [(1, "late", "U", 1, at(1)), (9, "z", "I", 0, at(25))],  # the deletion is newer
        [(9, "z", "U", 1, at(25)), (8, "y", "I", 0, at(26))],
        [(8, "y", "U", 1, at(26))],
    ]
    living = captured(spark, tmp_path, parts, late_by="10 hours")
    assert sorted((r["id"], r["v"]) for r in living.collect()) == [(3, "c"), (8, "y"), (9, "z")]
    state = spark.read.format("statestore").option("stateVarName", "newest").load(str(tmp_path / "state"))
    held = {r["key"]["id"]: r["value"]["deleted"] for r in state.select("key", "value").collect()}
    # The watermark stands at 20 hours: the tombstone of 2 hours is gone, that of 30 stays.
    assert held == {2: True, 3: False, 8: False, 9: False}


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(capture.STORE)
    with capture._rocksdb(spark):
        assert spark.conf.get(capture.STORE) == capture.ROCKSDB
    assert spark.conf.get(capture.STORE) == before


def test_versions_of_several_columns():
    ranks = [capture._rank(v) for v in ((None, None), (None, 1), (0, None), (0, 1), (1, None))]
    assert ranks == sorted(ranks) and len(set(ranks)) == 5
    assert F is not None


class CountedState:
    """A key's state and timers, which keeps the names of what is called."""

    def __init__(self):
        self.calls, self.value, self.timers = [], None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def listTimers(self):
        self.calls.append("listTimers")
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls.append("registerTimer")
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls.append("deleteTimer")
        self.timers.remove(at)


def test_a_key_takes_few_round_trips():
    change, state = Row("id", "op", "seq", "t"), CountedState()
    processor = capture.NewestChange(T.StructType([T.StructField("seq", T.IntegerType())]), "op", "t", 0)
    processor.init(state)

    def calls(*changes):
        state.calls.clear()
        let_through = list(processor.handleInputRows((1,), iter(change(1, op, seq, at(seq)) for op, seq in changes), None))
        return [r["seq"] for r in let_through], list(state.calls)

    assert calls(("I", 0)) == ([0], ["get", "update"])
    assert calls(("U", 2), ("U", 1)) == ([2], ["get", "update"])
    assert calls(("U", 1)) == ([], ["get"])
    assert calls(("D", 3)) == ([3], ["get", "update", "registerTimer"])
    # Only a tombstone has a timer, which goes with the next change.
    assert calls(("U", 4)) == ([4], ["get", "listTimers", "deleteTimer", "update"])
    assert state.timers == []


def operators(spark, checkpoint):
    return [r["operatorName"] for r in spark.read.format("state-metadata").load(str(checkpoint)).collect()]


def test_keys_are_held_in_the_jvm(spark, tmp_path):
    """The processor in Python takes half a millisecond a key, whatever it does."""
    captured(spark, tmp_path, [[(1, "a", "I", 0, at(0)), (2, "b", "I", 0, at(0))], [(1, "a", "D", 1, at(1))]])
    assert operators(spark, tmp_path / "state") == ["transformWithStateExec"]


def test_many_keys_on_a_stream_are_the_batch(spark, tmp_path):
    """Every third key is deleted, and an older update of it comes late; every third is updated; the rest are left."""
    n, folder = 200_000, str(tmp_path / "in")
    change = "id", "concat(id, '-', seq) AS v", "op", "seq", "timestamp_ntz'2024-01-01' + make_dt_interval(0, seq) AS t"
    kinds = {0: ("I", 0, 0), 1: ("D", 2, 0), 2: ("U", 1, 0), 3: ("U", 3, 1)}
    living = None
    for part in ((0,), (1, 3), (2,)):
        for op, seq, third in (kinds[k] for k in part):
            rows = spark.range(n).where(f"{seq} = 0 OR id % 3 = {third}").withColumns({"op": F.lit(op), "seq": F.lit(seq)}).selectExpr(*change)
            rows.write.mode("append").parquet(folder)
        stream = jobs.read_stream(spark, folder, rows.schema).drop("_source_file")
        living = capture.run_capture(stream, ["id"], ["seq"], "t", "100 hours", str(tmp_path / "table"), str(tmp_path / "state"), buckets=4)
    wanted = spark.range(n).where("id % 3 > 0").selectExpr("id", "concat(id, '-', if(id % 3 = 1, 3, 0)) AS v")
    got = living.select("id", "v")
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()


VERSIONS = {
    "double": [None, float("-inf"), -1.5, 0.0, 2.0, float("nan")],
    "string": [None, "", "Z", "a", "\uffee", "\U0001f600"],
    "binary": [None, b"", b"\x01", b"\x7f", b"\x80", b"\xff\x00"],
    "decimal(20,2)": [None, Decimal("-10.00"), Decimal("9.99"), Decimal("10.00")],
    "date": [None, date(1969, 1, 1), date(2024, 1, 2)],
    "timestamp": [None, datetime(1969, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 1), datetime(2024, 1, 2)],
    "timestamp_ntz": [None, datetime(1969, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 1), datetime(2024, 1, 2)],
    "boolean": [None, False, True],
    "tinyint": [None, -128, 127],
    "array<int>": [[], [1], [1, 2], [3]],
}


@pytest.mark.parametrize("kind", VERSIONS)
def test_versions_are_ordered_as_in_the_table(spark, tmp_path, kind):
    """Of two changes in a row the newer is let through, and of two in one batch the newest, whichever comes first."""
    values = VERSIONS[kind]
    pairs = [(i, j) for i in range(len(values)) for j in range(len(values))]
    schema, folder = f"id string, op string, version {kind}, place int, t timestamp", str(tmp_path / "in")
    with capture._rocksdb(spark):
        for part in (0, 1):
            rows = [(f"{p}", "U", values[p[part]], p[part], at(0)) for p in pairs]
            rows += [(f"at once {p}", "U", values[place], place, at(0)) for p in pairs for place in p if not part]
            df = spark.createDataFrame(rows, schema).coalesce(1)
            df.write.mode("append").parquet(folder)
            stream = jobs.read_stream(spark, folder, df.schema).drop("_source_file")
            newest = capture.newest_changes(stream, ["id"], ["version"], "t", "1 hour")
            got = jobs.run_append(newest, str(tmp_path / "out"), str(tmp_path / "state"))
    let_through = sorted((r["id"], r["place"]) for r in got.collect())
    wanted = [(f"{p}", p[0]) for p in pairs] + [(f"{p}", p[1]) for p in pairs if p[1] > p[0]] + [(f"at once {p}", max(p)) for p in pairs]
    assert let_through == sorted(wanted)
    in_python = kind == "array<int>"
    assert operators(spark, tmp_path / "state") == [capture.PYTHON_OPERATOR if in_python else "transformWithStateExec"]


def test_several_version_columns_and_keys(spark, tmp_path):
    schema = "a int, b string, day date, n int, op string, t timestamp"
    first, last = date(2024, 1, 1), date(2024, 1, 2)
    parts = [
        [(1, None, first, 5, "I", at(0)), (1, "x", last, 1, "I", at(0)), (None, None, last, None, "I", at(0))],
        [(1, None, last, 1, "U", at(1)), (1, "x", first, 9, "D", at(1)), (None, None, last, 0, "U", None)],
        [(1, None, last, 0, "D", at(1)), (1, "x", last, 2, "D", None), (None, None, None, 9, "D", at(1))],
    ]
    folder, living = str(tmp_path / "in"), None
    for part in parts:
        df = spark.createDataFrame(part, schema)
        df.write.mode("append").parquet(folder)
        stream = jobs.read_stream(spark, folder, df.schema).drop("_source_file")
        living = capture.run_capture(stream, ["a", "b"], ["day", "n"], "t", "9 hours", str(tmp_path / "table"), str(tmp_path / "state"), buckets=2)
    assert sorted((tuple(r) for r in living.select("a", "b", "day", "n").collect()), key=repr) == [(1, None, last, 1), (None, None, last, 0)]
    state = spark.read.format("statestore").option("stateVarName", "newest").load(str(tmp_path / "state"))
    held = {tuple(r["key"]): tuple(r["value"]) for r in state.select("key", "value").collect()}
    assert held == {(1, None): (last, 1, False), (1, "x"): (last, 2, True), (None, None): (last, 0, False)}


def test_checkpoints_of_the_processor_in_python_go_on(spark, tmp_path, monkeypatch):
    with monkeypatch.context() as before:
        before.setattr(capture.compiled, "can_run", lambda schema, version: False)
        captured(spark, tmp_path, [[(1, "a", "I", 1, at(0)), (2, "b", "D", 3, at(0))]])
    living = captured(spark, tmp_path, [[(1, "old", "U", 0, at(1)), (2, "old", "U", 2, at(1)), (3, "c", "I", 0, at(1))]])
    assert sorted((r["id"], r["v"]) for r in living.collect()) == [(1, "a"), (3, "c")]
    assert set(operators(spark, tmp_path / "state")) == {capture.PYTHON_OPERATOR}


def test_a_stream_that_failed_in_its_first_batch_starts_again(spark, tmp_path, monkeypatch):
    def fail(*_):
        raise RuntimeError("no table")

    with monkeypatch.context() as broken:
        broken.setattr(jobs, "upsert_buckets", fail)
        with pytest.raises(Exception, match="no table"):
            captured(spark, tmp_path, [[(1, "a", "I", 0, at(0))]])
    living = captured(spark, tmp_path, [[(2, "b", "I", 0, at(0))]])
    assert sorted((r["id"], r["v"]) for r in living.collect()) == [(1, "a"), (2, "b")]


def test_every_session_of_an_application_has_the_class(spark, tmp_path):
    other = spark.newSession()
    other.conf.set("spark.sql.datetime.java8API.enabled", "true")
    other.conf.set("spark.sql.session.timeZone", "UTC")
    living = captured(other, tmp_path, [[(1, "a", "I", 0, at(0)), (2, "b", "D", 1, at(0))], [(2, "old", "U", 0, at(0))]])
    assert [(r["id"], r["v"]) for r in living.collect()] == [(1, "a")]
