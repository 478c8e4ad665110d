"""Hot pieces, nested drift, panes, shared keys over several steps, erasure by file, several quantiles, folds and deletions."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tierflow.operators import components, core, erasure, joins, load, ordered, quality, rules
from tierflow.plans.bronze import run_bronze
from tierflow.sources import files
from tierflow.specs import EntitySpec
from tierflow.streaming import jobs


# ---- joins in blocks


def test_join_in_blocks_is_a_join(spark, rows):
    a = spark.range(300).selectExpr("IF(id < 200, 'hot', concat('k', id % 7)) AS k", "id AS x")
    b = spark.range(250).selectExpr("IF(id < 150, 'hot', concat('k', id % 9)) AS k", "id AS y")
    wanted = rows(a.join(b, "k").select("k", "x", "y"))
    for block in (10, 64, 10_000):
        assert rows(joins.join_in_blocks(a, b, ["k"], "x", "y", block).select("k", "x", "y")) == wanted


def test_names_that_share_a_piece(spark, monkeypatch):
    """Every name begins alike: the pairs are brute force's, and no key holds more than its two blocks."""
    draw = random.Random(1)
    names = sorted({"common piece " + "".join(draw.choices("abc", k=6)) for _ in range(300)})
    df = spark.createDataFrame([("b", n) for n in names], "block string, name string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    wanted = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if distance(a, b) <= 1}
    monkeypatch.setattr(joins, "BLOCK_ROWS", 40)
    found = core.fuzzy_match(df, df, "block", "name", 1, self_match=True)
    assert {(r["name_a"], r["name_b"]) for r in found.collect()} == wanted
    a = df.withColumn("_piece", F.explode(core.text_pieces(F.col("name"), 1))).withColumnRenamed("name", "x")
    largest = {}
    for side, own in ((a, "x"), (a.withColumnRenamed("x", "y"), "y")):
        dealt = joins.join_in_blocks(side.limit(0).unionByName(side), a.withColumnRenamed("x", "z"), ["block", "_piece"], own, "z", 40)
        largest[own] = dealt.groupBy("block", "_piece").count().agg(F.max("count")).first()[0]
    assert largest["x"] == largest["y"] == len(names) ** 2


# ---- nested drift

OLD = "id int, line struct<a:int,b:array<struct<c:int>>,m:map<string,int>>, tags array<int>"
NEW = "id int, line struct<a:bigint,b:array<struct<c:int,d:string>>,m:map<string,double>,e:date>, tags array<string>, more struct<x:int>"


def test_nested_drift_names_paths(spark):
    old, new = (spark.createDataFrame([], s) for s in (OLD, NEW))
    assert quality.schema_drift(old, new) == [
        ("type_changed", "line.a", "int", "bigint"),
        ("added", "line.b[].d", None, "string"),
        ("added", "line.e", None, "date"),
        ("type_changed", "line.m{value}", "int", "double"),
        ("added", "more", None, "struct<x:int>"),
        ("type_changed", "tags[]", "int", "string"),
    ]
    assert quality.schema_drift(new, new) == []
    assert quality.schema_drift(new, old)[1] == ("removed", "line.b[].d", "string", None)


def test_nested_union_keeps_structs(spark):
    old = spark.createDataFrame([(1, (5, [(7,), None], {"k": 2}), [1, None]), (2, None, None)], OLD)
    new = spark.createDataFrame([(3, (2**40, [(8, "d")], {"k": 0.5}, None), ["x"], (4,))], NEW)
    for one, other in ((old, new), (new, old)):
        got = quality.evolve_union(one, other)
        kinds = dict(got.dtypes)
        assert kinds["tags"] == "array<string>" and kinds["more"] == "struct<x:int>"
        rows = {r["id"]: r.asDict(True) for r in got.collect()}
        assert rows[1]["line"] == {"a": 5, "b": [{"c": 7, "d": None}, None], "m": {"k": 2.0}, "e": None}
        assert (rows[1]["tags"], rows[1]["more"], rows[2]["line"], rows[2]["tags"]) == (["1", None], None, None, None)
        assert rows[3]["line"]["a"] == 2**40 and rows[3]["line"]["b"] == [{"c": 8, "d": "d"}] and rows[3]["more"] == {"x": 4}


def test_a_struct_that_became_a_number_is_json(spark):
    old = spark.createDataFrame([(1, (5,))], "id int, v struct<a:int>")
    new = spark.createDataFrame([(2, 7)], "id int, v int")
    assert sorted((r["id"], r["v"]) for r in quality.evolve_union(old, new).collect()) == [(1, '{"a":5}'), (2, "7")]


# ---- panes


@pytest.mark.parametrize("width, step", [(60, 15), (60, 40), (30, 30)])
def test_panes_are_sliding_windows(spark, rows, width, step):
    draw = random.Random(width + step)
    start = datetime(2024, 3, 30, 22)
    data = [(start + timedelta(seconds=draw.randrange(40_000)), draw.choice("ab"), draw.randrange(100)) for _ in range(400)]
    data += [(start + timedelta(minutes=m), "a", 1) for m in range(0, 600, 5)] + [(None, "a", 5)]
    events = spark.createDataFrame(data, "t timestamp_ntz, k string, v int")
    wanted = jobs.sliding(events, "t", f"{width} minutes", f"{step} minutes", ["k"], F.count("*").alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    got = jobs.sliding_by_panes(events, "t", width, step, ["k"], n=("count", "*"), s=("sum", "v"), lo=("min", "v"), hi=("max", "v"))
    assert rows(got.select("window_start", "window_end", "k", "n", "s", "lo", "hi")) == rows(wanted.select("window_start", "window_end", "k", "n", "s", "lo", "hi"))


def test_panes_on_a_stream(spark, tmp_path, rows):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    schema = "t timestamp_ntz, v int"
    batch = spark.createDataFrame([(at(1, i), i) for i in range(0, 60, 7)] + [(at(2, 5), 1), (at(9), 0)], schema)
    batch.write.parquet(str(tmp_path / "in"))
    batch.limit(1).withColumn("t", F.lit(at(9, 30)).cast("timestamp_ntz")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.with_watermark(jobs.read_stream(spark, str(tmp_path / "in"), batch.schema), "t", "10 minutes")
    windows = jobs.sliding_by_panes(stream, "t", 60, 30, [], n=("count", "*"), s=("sum", "v"))
    got = jobs.run_append(windows, str(tmp_path / "out"), str(tmp_path / "state")).select(F.date_format("window_start", "HH:mm"), "n", "s")
    assert rows(got) == [("00:30", 5, 70), ("01:00", 9, 252), ("01:30", 5, 183), ("02:00", 1, 1)]


# ---- shared keys


def test_people_over_several_steps(spark):
    draw = random.Random(2)
    records = [(i, draw.choice([None, *range(60)]), draw.choice([None, *(f"m{k}" for k in range(70))])) for i in range(150)]
    records += [(1000 + i, 1000 + i // 2, f"c{(i + 1) // 2}") for i in range(400)]  # one chain of 400
    records += [(5000 + i, 77_777, None) for i in range(300)] + [(9000, None, None)]
    parent = {r[0]: r[0] for r in records}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for key in (1, 2):
        first = {}
        for r in records:
            if r[key] is not None:
                a, b = find(r[0]), find(first.setdefault(r[key], r[0]))
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(records, "id bigint, phone bigint, mail string").repartition(4)
    found = {r["id"]: r["person_id"] for r in components.resolve_records(df, "id", ["phone", "mail"]).collect()}
    assert found == {i: find(i) for i in parent}
    assert components.components(spark.createDataFrame([(None, 1), (2, 2)], "a bigint, b bigint")).count() == 0


# ---- erasure


def checksums(folder):
    return {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.glob("*.parquet")}


def test_erasure_rewrites_only_what_it_must(spark, tmp_path, rows):
    path, table = str(tmp_path / "t"), tmp_path / "t"
    df = spark.range(20_000).selectExpr("id", "id DIV 10 AS person", "concat('v', id) AS v").unionByName(spark.createDataFrame([(-1, None, "x")], "id bigint, person bigint, v string"))
    df.repartitionByRange(20, "person").write.parquet(path)
    before = checksums(table)
    subjects = spark.createDataFrame([(5,), (6,), (1500,), (None,), (99_999_999,)], "person bigint")
    report = erasure.erase_by_file(spark, path, subjects, "person")
    after = checksums(table)
    untouched = {n for n in before if after.get(n) == before[n]}
    assert report["erased"] == 30 and report["files"] == 20
    assert len(untouched) == 20 - report["rewritten"] >= 16
    stored = spark.read.parquet(path)
    assert rows(stored) == rows(df.where("person IS NULL OR person NOT IN (5, 6, 1500)"))
    # The index followed: nothing is found a second time, but by mistake.
    again = erasure.erase_by_file(spark, path, subjects, "person")
    assert again["erased"] == 0 and again["rewritten"] <= 2
    assert erasure.erase_by_file(spark, path, spark.createDataFrame([(7,)], "person bigint"), "person")["erased"] == 10
    assert spark.read.parquet(path).count() == 20_001 - 40


def test_the_index_loses_no_subject(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).selectExpr("id % 977 AS person").repartition(6).write.parquet(path)
    index = erasure.subject_index(spark.read.parquet(path), "person")
    for person in (0, 13, 976):
        wanted = {r[0].rsplit("/", 1)[-1] for r in spark.read.parquet(path).where(f"person = {person}").select("_metadata.file_path").distinct().collect()}
        found = {r["file"] for r in erasure.files_with(index, spark.createDataFrame([(person,)], "person bigint"), "person").collect()}
        assert wanted <= found
    missing = spark.range(100_000, 100_400).toDF("person")
    each = [erasure.files_with(index, missing.where(f"person = {100_000 + i}"), "person").count() for i in range(5)]
    assert sum(each) <= 6  # of 30, by mistake


def test_an_unfinished_erasure_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id DIV 10 AS person").repartitionByRange(5, "id").write.parquet(path)
    swap = erasure._swap

    def stopped(spark_, at, old, new):
        swap(spark_, at, old, [])  # old files are gone, new ones still hidden
        raise KeyboardInterrupt

    monkeypatch.setattr(erasure, "_swap", stopped)
    with pytest.raises(KeyboardInterrupt):
        erasure.erase_by_file(spark, path, spark.createDataFrame([(3,)], "person bigint"), "person")
    monkeypatch.setattr(erasure, "_swap", swap)
    assert erasure.finish_erasures(spark, path, "person") == 1
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [i for i in range(100) if i // 10 != 3]
    assert erasure.finish_erasures(spark, path, "person") == 0


# ---- quantiles of several orders


@pytest.mark.parametrize("n, buckets, splitters, held", [(1000, 5, 128, 1_000_000), (1003, 7, 4, 50), (3, 5, 128, 10), (0, 5, 128, 10), (200, 1, 8, 10)])
def test_ntiles_are_windows(spark, monkeypatch, rows, n, buckets, splitters, held):
    monkeypatch.setattr(ordered, "SPLITTERS", splitters)
    monkeypatch.setattr(ordered, "ORDERED_ROWS", held)
    df = spark.range(n).selectExpr("IF(id = 17, NULL, id) AS id", "IF(id % 13 = 0, NULL, id % 10) AS x", "CAST(hash(id) % 50 AS double) AS y").repartition(3)
    orders = {"a": [("x", True), ("id", False)], "b": [("x", False), ("id", True)], "c": [("y", False), ("id", False)]}
    got = ordered.ntiles(df, buckets, orders)
    for name, order in orders.items():
        by = ", ".join(f"{c} {'DESC' if d else 'ASC'}" for c, d in order)
        assert rows(got.select("id", "x", name)) == rows(df.selectExpr("id", "x", f"ntile({buckets}) OVER (ORDER BY {by}) AS {name}"))


# ---- folds and deletions


def test_a_fold_keeps_what_is_appended_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows_of = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "id bigint, v int")
    load.upsert_buckets(rows_of(1, 2), path, ["id"], ["-v"], buckets=4)
    write = load._write_buckets

    def slow(df, at, *options):
        write(df, at, *options)
        if at.endswith("/base"):  # another writer, while the base is written
            write(rows_of(3), f"{path}/changes", ["id"], 4, "append")

    monkeypatch.setattr(load, "_write_buckets", slow)
    load.fold_buckets(spark, path, rows_of(1).schema)
    monkeypatch.setattr(load, "_write_buckets", write)
    assert sorted(r["id"] for r in load.read_buckets(spark, path, rows_of(1).schema).collect()) == [1, 2, 3]
    load.fold_buckets(spark, path, rows_of(1).schema)
    load.fold_buckets(spark, path, rows_of(1).schema)  # nothing left to fold
    assert sorted(r["id"] for r in load.read_buckets(spark, path, rows_of(1).schema).collect()) == [1, 2, 3]


def test_small_changes_wait(spark, tmp_path, monkeypatch):
    df, path = spark.createDataFrame([(1, 1)], "id bigint, v int"), str(tmp_path / "t")
    load.upsert_buckets(df, path, ["id"], ["-v"], buckets=4)
    assert not (tmp_path / "t" / "base").exists()
    monkeypatch.setattr(load, "FOLD_LEAST", 0)
    load.upsert_buckets(df.withColumn("v", F.lit(2)), path, ["id"], ["-v"], buckets=4)
    assert (tmp_path / "t" / "base").exists()
    assert [tuple(r) for r in load.read_buckets(spark, path, df.schema).collect()] == [(1, 2)]


def test_incremental_deletes(spark, rows):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 3)], "id int, v string, t int")
    source = spark.createDataFrame([(1, "old", 1, True), (2, "new", 4, False), (3, "c", 5, True), (5, "e", 4, None), (6, "f", 4, False)], "id int, v string, t int, gone boolean")
    log = spark.createDataFrame([(4, 4), (1, 2), (6, 4)], "id int, t int")
    got = load.incremental_merge(source, target, ["id"], "t", F.col("gone"), log)
    assert rows(got) == [(1, "a", 1), (2, "new", 4), (5, "e", 4)]
    assert rows(load.incremental_merge(source, target, ["id"], "t", F.col("gone"))) == [(1, "a", 1), (2, "new", 4), (4, "d", 3), (5, "e", 4), (6, "f", 4)]


# ---- XML, quarantine, extraction


def test_xml(spark, tmp_path, rows):
    (tmp_path / "a.xml").write_text('<shop><item id="1"><name>é &amp; b</name><tag>x</tag><tag>y</tag></item><item id="2"/></shop>')
    schema = "_id int, name string, tag array<string>"
    found = files.scan_xml(spark, str(tmp_path / "a.xml"), "item", spark.createDataFrame([], schema).schema)
    assert rows(found.select("_id", "name", "tag")) == [(1, "é & b", ["x", "y"]), (2, None, None)]
    assert found.first()[files.SOURCE_FILE].endswith("a.xml")
    assert files.scan(spark, str(tmp_path), "xml", row_tag="item").count() == 2
    with pytest.raises(ValueError, match="row tag"):
        files.scan(spark, str(tmp_path), "xml")


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_quarantine(spark, tmp_path, fmt):
    lines = {"json": '{"id": 1, "price": 2.5}\n{"id": 2, "pri\n{"id": 3, "price": 1.5}\n', "csv": "id,price\n1,2.5\nx,y,z,1\n3,1.5\n"}[fmt]
    (tmp_path / f"a.{fmt}").write_text(lines)
    spec = EntitySpec("e", fmt=fmt, schema=spark.createDataFrame([], "id int, price double").schema, multi_line=False)
    run = run_bronze(spark, spec, str(tmp_path / f"a.{fmt}"), str(tmp_path / "bronze"), "20240101", quarantine_path=str(tmp_path / "aside"))
    assert (run.rows, run.quarantined) == (2, 1)
    bronze, aside = (spark.read.parquet(str(tmp_path / x)) for x in ("bronze", "aside"))
    assert sorted(r["id"] for r in bronze.collect()) == [1, 3] and files.CORRUPT not in bronze.columns
    row = aside.first()
    assert row[files.CORRUPT] in lines and row[files.SOURCE_FILE].endswith(f"a.{fmt}") and row["_processing_date"] == "20240101"


def test_extractions_can_be_withdrawn(spark):
    one, two = rules.Extraction("erp"), rules.Extraction("erp", "run-2", datetime(2024, 1, 1))
    df = spark.range(2).toDF("id")
    both = one.on(df).unionByName(two.on(df)).unionByName(df, allowMissingColumns=True)
    assert one.extraction_id != rules.Extraction("erp").extraction_id
    left = rules.without_extractions(both, "run-2")
    assert sorted(str(r["extraction_id"]) for r in left.collect()) == sorted([one.extraction_id] * 2 + ["None"] * 2)


# ---- marts kept up to date


def test_a_maintained_mart_is_a_full_build(spark, tmp_path, rows):
    from decimal import Decimal

    from tierflow.operators import maintenance

    draw = random.Random(8)
    schema = "id int, g string, h int, amount decimal(18,2), day int"
    make = lambda i: (i, draw.choice(["a", "b", None]), draw.randrange(3), draw.choice([None, Decimal(draw.randrange(1000)) / 100]), draw.choice([None, *range(6)]))
    mart = maintenance.Mart(("g", "h"), {"total": "amount"}, {"days": "day", "amounts": "amount"}, {"first": ("min", "day"), "last": ("max", "day"), "top": ("max", "amount")})
    state, path = {}, str(tmp_path / "m")
    frame = lambda x: spark.createDataFrame(list(x), schema)
    assert maintenance.read_mart(spark, mart, path, frame([]).schema).count() == 0
    for version in range(1, 5):
        before, after = [], []
        for i in draw.sample(range(60), 25):
            if i in state:
                before.append(state.pop(i))
            if draw.random() < (0.9 if version < 4 else 0.2):
                state[i] = make(i)
                after.append(state[i])
        batch = maintenance.images(frame(before), frame(after))
        for _ in range(2 if version == 2 else 1):
            maintenance.maintain(batch, mart, path, version, buckets=3)
        got = maintenance.read_mart(spark, mart, path, frame([]).schema)
        wanted = maintenance.full_build(frame(state.values()), mart)
        assert rows(got.select(*wanted.columns)) == rows(wanted)


def test_a_batch_that_broke_off_is_finished(spark, tmp_path, rows, monkeypatch):
    from tierflow.operators import maintenance

    mart, path = maintenance.Mart(("g",), {"s": "v"}, {"n": "v"}), str(tmp_path / "m")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "g string, v int")
    append, calls = maintenance._append, []

    def once(*args):
        if calls:
            raise KeyboardInterrupt
        calls.append(1)
        append(*args)

    monkeypatch.setattr(maintenance, "_append", once)
    with pytest.raises(KeyboardInterrupt):
        maintenance.maintain(maintenance.images(None, df), mart, path, 1, 2)
    monkeypatch.setattr(maintenance, "_append", append)
    maintenance.maintain(maintenance.images(None, df), mart, path, 1, 2)
    got = maintenance.read_mart(spark, mart, path, df.schema)
    assert rows(got.select("g", "n_rows", "s", "n")) == [("a", 2, 3, 2), ("b", 1, 2, 1)]


def test_tasks_of_a_join_do_not_grow_with_the_table(spark, rows, monkeypatch):
    """Twice the rows go to twice the partitions; the result is that of the plain join."""
    monkeypatch.setattr(joins, "TASK_ROWS", 50)
    for n in (1000, 2000):
        left = spark.range(n).selectExpr("IF(id % 10 = 0, null, id % 300) AS a", "id AS x")
        right = spark.range(300).selectExpr("id AS b", "id * 7 AS y")
        dealt, other = joins.dealt([(left, "a"), (right, "b")], n)
        assert dealt.rdd.getNumPartitions() == other.rdd.getNumPartitions() == n // 50
        assert rows(dealt.join(other, F.col("a") == F.col("b"))) == rows(left.join(right, F.col("a") == F.col("b")))
    small = spark.range(50)
    assert joins.dealt([(small, "id")], 50) == [small]
