from __future__ import annotations

import json
import random

import pytest

from tierflow.sources import paging

RESPONSES = "request_id string, page int, status int, body string, error string"


def body(*items):
    return json.dumps(list(items))


def recorded(draw, requests=5, pages=30):
    """Responses of requests that end in different ways, and where each ends."""
    rows, ends = [], {}
    for k in range(requests):
        end = draw.randint(1, pages)
        kind = draw.choice(["empty", "failed", "missing", "unparsed", "none"])
        for page in range(1, pages + 1):
            row = (f"r{k}", page, 200, body(page, k), None)
            if page == end and kind != "none":
                row = {
                    "empty": (*row[:3], "[]", None), "failed": (*row[:2], 503, None, "HTTP 503"),
                    "unparsed": (*row[:3], "<html>", None), "missing": None,
                }[kind]
            if row:
                rows.append(row)
        ends[f"r{k}"] = pages + 1 if kind == "none" else end
    return rows, ends


def kept_of(df):
    return sorted((r["request_id"], r["page"], r["body"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_and_stream_end_at_the_first_gap(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows, ends = recorded(draw)
    wanted = sorted((r, p, b) for r, p, _, b, _ in rows if p < ends[r])
    path, kept, state = (str(tmp_path / x) for x in ("recorded", "kept", "state"))
    for last, first in ((8, 1), (20, 9), (30, 21)):
        part = [r for r in rows if first <= r[1] <= last]
        paging.record_pages(spark.createDataFrame(part, RESPONSES).repartition(3), path, pages_a_wave=4)
        got = paging.run_sequences(paging.stream_pages(spark, path), kept, state)
        assert kept_of(got) == [w for w in wanted if w[1] <= last]
    # Nothing new: the stream has nothing to do.
    assert kept_of(paging.run_sequences(paging.stream_pages(spark, path), kept, state)) == wanted
    assert kept_of(paging.sequences(paging.read_pages(spark, path, 4))) == wanted


def test_a_request_that_joins_late_starts_at_page_one(spark, tmp_path):
    path, kept, state = (str(tmp_path / x) for x in ("recorded", "kept", "state"))
    for part in ([("a", 1, 200, "[1]", None)], [("a", 2, 200, "[1]", None), ("b", 2, 200, "[1]", None), ("b", 3, 200, "[1]", None)]):
        paging.record_pages(spark.createDataFrame(part, RESPONSES), path, pages_a_wave=1)
        got = paging.run_sequences(paging.stream_pages(spark, path), kept, state)
    assert kept_of(got) == [("a", 1, "[1]"), ("a", 2, "[1]")]


def test_bounds_of_pages_leave_files_unread(spark, tmp_path):
    path = str(tmp_path / "recorded")
    rows = [("a", p, 200, body(p), None) for p in range(1, 41)]
    paging.record_pages(spark.createDataFrame(rows, RESPONSES), path, pages_a_wave=10)
    pages = paging.read_pages(spark, path, 10)
    for condition, wanted, waves in (("page > 20 AND page <= 25", 5, 1), ("page = 10", 1, 1), ("page >= 10 AND page < 12", 2, 2), ("page < 1", 0, 0)):
        found = pages.where(condition)
        assert found.count() == wanted
        assert found.rdd.getNumPartitions() == max(1, waves)
    assert pages.columns == ["request_id", "page", "status", "body", "error"]


def test_nothing_recorded(spark, tmp_path):
    assert paging.read_pages(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="path"):
        spark.read.format("recorded_pages").load().count()


def test_first_gap(spark):
    pages = spark.createDataFrame(
        [("a", 1, 1, None), ("a", 2, 1, None), ("a", 4, 1, None), ("b", 2, 1, None), ("c", 1, 0, None), ("d", 3, 1, None), ("d", 4, 1, "x")],
        "request_id string, page int, n_items int, error string",
    )
    reached = spark.createDataFrame([("d", 2), ("a", 1)], "request_id string, reached int")
    assert sorted(map(tuple, paging.first_gap(pages).collect())) == [("a", 3), ("b", 1), ("c", 1), ("d", 1)]
    assert sorted(map(tuple, paging.first_gap(pages, reached).collect())) == [("a", 3), ("b", 1), ("c", 1), ("d", 4)]


def test_many_small_files_share_partitions(spark, tmp_path, rows):
    path = str(tmp_path / "recorded")
    pages = [("a", page, 200, "[1]", None) for page in range(1, 401)]
    paging.record_pages(spark.createDataFrame(pages, RESPONSES), path, pages_a_wave=1)
    found = paging.read_pages(spark, path, pages_a_wave=1)
    assert 1 < found.rdd.getNumPartitions() <= 2 * paging.PARTITIONS
    assert rows(found.select("page")) == sorted(((p[1],) for p in pages), key=repr)
    sized = [paging.WaveFile(w, f"f{w}", 5 << 20) for w in range(1000)]
    parts = paging.packed(sized)
    assert [f for p in parts for f in p.paths] == [f.path for f in sized] and {len(p.paths) for p in parts[:-1]} == {3}
    assert len(paging.packed([paging.WaveFile(0, "large", 1 << 30), paging.WaveFile(1, "small", 1)])) == 2


def test_a_sequence_reads_its_source_once(spark, tmp_path):
    opened = spark.sparkContext.accumulator(0)

    def counting(df):
        def seen(batches):
            for batch in batches:
                opened.add(batch.num_rows)
                yield batch

        return paging.counted(df.mapInArrow(seen, df.schema))

    pages = spark.createDataFrame([("a", page, 200, "[1]" if page < 5 else "[]", None) for page in range(1, 9)], RESPONSES)
    assert paging.sequences(pages, counting).count() == 4
    assert opened.value == 8
