"""Shingle join, components, fingerprints and nearest neighbours against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import sys

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tierflow import workspace
from tierflow.llm import forest, jaccard, winnow, words
from tierflow.llm.components import connected_components

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(found) < 5:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def brute_components(rows):
    """(doc_id, set size, smallest id reachable) of each row."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        key = find(i)
        least[key] = min(least.get(key, 1 << 62), doc_id)
    return [(doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows)]


def near_copies(seed=3):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]
    rows = []
    for group in range(6):
        base = [word() for _ in range(draw.randint(4, 120))]
        for _ in range(draw.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    for _ in range(30):  # a common passage in otherwise different texts
        rows.append(" ".join([*passage, *(word() for _ in range(draw.randint(5, 40)))]))
    rows += ["One two", "one TWO", "one two three", "a a a a a a a a", "", " \n", None, "x y z w v", "X y z w v"]
    rows += rows[:4]
    return [(10 * i + 3, text) for i, text in enumerate(rows)]


@pytest.fixture(scope="module")
def copies(spark):
    rows = near_copies()
    extra = [(i, t, f"n{i}", 1) for i, t in rows]
    return rows, spark.createDataFrame(extra, "doc_id bigint, text string, node string, hashes int").repartition(5)


def test_join_is_brute_force(spark, copies):
    rows, docs = copies
    joined = jaccard.join(docs).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, joined.collect())) == sorted(brute_components(rows))


@pytest.mark.parametrize("sets, shingles_held", [(3, 500_000), (1000, 150), (1, 1)])
def test_blocks_of_large_groups(spark, copies, monkeypatch, sets, shingles_held):
    rows, docs = copies
    monkeypatch.setattr(jaccard, "BLOCK", sets)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles_held)
    joined = jaccard.join(docs).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, joined.collect())) == sorted(brute_components(rows))


def test_every_pair_that_may_link_meets_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    sizes = [*range(1, 60), 100, 133, 134, 300, 400, 401, 9]
    members = spark.createDataFrame([("g", i, n) for i, n in enumerate(sizes)] + [("h", 900, 5)], "group string, node bigint, n int")
    tasks = {}
    for r in jaccard._blocks(members, 75).collect():
        tasks.setdefault(tuple(r)[:5], []).append((r["node"], r["is_first"]))
    met = []
    for key, got in tasks.items():
        within = key[1:3] == key[3:5]
        met += [(a, b) for a, fa in got for b, fb in got if a < b and (within or fa != fb)]
    assert len(met) == len(set(met))
    assert {(a, b) for a in range(len(sizes)) for b in range(a) if 4 * min(sizes[a], sizes[b]) >= 3 * max(sizes[a], sizes[b])} <= {(b, a) for a, b in met}


def test_divide_skip_is_brute_force():
    draw = np.random.default_rng(8)
    for share in (60, 75, 90):
        base = draw.integers(0, 1 << 60, 400).astype(np.uint64)
        sets = []
        for _ in range(60):
            kept = base[draw.random(400) < draw.choice([0.1, 0.9, 0.97])]
            sets.append(np.unique(np.concatenate([kept, draw.integers(0, 1 << 60, int(draw.choice([0, 3, 40]))).astype(np.uint64)])))
        sets = sorted((x for x in sets if len(x)), key=len)
        index = jaccard.Inverted(sets)
        links = 0
        for query, x in enumerate(sets):
            allowed = draw.random(len(sets)) < 0.8
            wanted = [
                i for i, y in enumerate(sets)
                if i > query and allowed[i] and 100 * (c := len(np.intersect1d(x, y))) >= share * (len(x) + len(y) - c)
            ]
            assert jaccard.divide_skip(index, query, allowed, share).tolist() == wanted
            links += len(wanted)
        assert links > 20
    alone = jaccard.Inverted([np.array([1], np.uint64), np.array([2, 3], np.uint64)])
    assert not len(jaccard.divide_skip(alone, 0, np.ones(2, bool)))


def test_a_shared_passage_links_nothing(spark):
    """200 long texts that share a passage, each with a copy too far off to link: no task returns a pair."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    passage = [word() for _ in range(400)]
    rows = []
    for i in range(100):
        own = [word() for _ in range(4600)]
        # Every sixth text has a copy that does link.
        changed = [word() if draw.random() < (0.01 if i % 6 == 0 else 0.045) else w for w in own]
        rows += [(2 * i, " ".join(own + passage)), (2 * i + 1, " ".join(passage + changed))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    sets = [(int(jaccard.class_of(x)), len(x), x.view(np.int64).tolist()) for x in jaccard.shingle_sets([t for _, t in rows])]
    frame = spark.createDataFrame(sets, "node bigint, n int, shingles array<bigint>")
    members = frame.selectExpr("'g' AS group", "node", "n", "node AS component")
    found = members.join(frame.select("node", "shingles"), "node").selectExpr("*", "true AS within", "true AS is_first")
    links = found.groupBy("group").applyInArrow(jaccard._linked(75), "a bigint, b bigint").collect()
    assert len(links) == 17
    joined = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
    assert joined == {i: i - i % 2 if i // 2 % 6 == 0 else i for i, _ in rows}


def test_one_of_each_group_stays(spark, copies):
    rows, docs = copies
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    wanted = [i for i, _, least in brute_components(rows) if i == least]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(wanted)


def test_repeated_ids_and_nulls(spark):
    same = "a b c d e f g h"
    docs = spark.createDataFrame([(5, same), (5, same), (3, same), (5, "q r s t u v"), (None, "q r s t u v"), (None, None), (7, "")], "doc_id bigint, text string")
    joined = jaccard.join(docs).select("doc_id", "n_shingles", "component_id")
    wanted = [(5, 4, 3), (5, 4, 3), (3, 4, 3), (5, 2, 5), (None, 2, 5), (None, 0, None), (7, 0, 7)]
    assert sorted(map(repr, map(tuple, joined.collect()))) == sorted(map(repr, wanted))
    kept = jaccard.keep_one(docs).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(3, same), (5, "q r s t u v"), (None, None), (7, "")]))
    assert jaccard.join(docs.limit(0)).count() == 0 and jaccard.keep_one(docs.limit(0)).count() == 0


def test_pruning_keeps_every_pair():
    """Two sets that link share as many prefix hashes as the pruning asks for."""
    draw = np.random.default_rng(1)
    for _ in range(300):
        n = int(draw.integers(1, 200))
        x = np.unique(draw.integers(0, 1 << 60, n))
        y = x.copy()
        y[draw.choice(len(x), int(len(x) * draw.uniform(0, 0.2)), replace=False)] += 1
        y = np.unique(y[: int(len(y) * draw.uniform(0.8, 1)) or 1])
        common = len(np.intersect1d(x, y))
        if 100 * common >= 75 * (len(x) + len(y) - common):
            both = np.intersect1d(x[: jaccard.prefix_length(len(x))], y[: jaccard.prefix_length(len(y))])
            assert len(both) >= max(jaccard.least_found(len(x)), jaccard.least_found(len(y)))


def test_components(spark):
    draw = random.Random(5)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7), (None, 3)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links[:-2]:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert found == {x: find(x) for x in list(parent) if any(find(y) == find(x) and y != x for y in parent)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_fingerprint(text):
    blank, marks = r" \t\n\x0b\f\r", "aeiou05\u0e00-\u0eff\u1000-\u11ff\u1780-\u17ff\u2e80-\uffff\U00010000-\U0010ffff"
    piece = rf"(?<![^{blank}])[^{blank}]{{1,16}}(?![^{blank}])|[^{blank}{marks}]{{0,15}}[{marks}]|[^{blank}{marks}]{{1,16}}"
    pieces = re.findall(piece, (text or "").lower())
    number = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed)
    pair = lambda a, b: number(struct.pack("<Q", b), number(struct.pack("<Q", a)))
    hashes = [number(p.encode()) for p in pieces]
    if not hashes:
        return ""
    if len(hashes) < 4:
        whole = 42
        for h in hashes:
            whole = number(struct.pack("<Q", h), whole)
        grams = [whole]
    else:
        two = [pair(a, b) for a, b in zip(hashes, hashes[1:])]
        grams = [pair(a, b) for a, b in zip(two, two[2:])]
    grams = [g >> 31 for g in grams]
    chosen = []
    for i in range(max(1, len(grams) - 7)):
        window = grams[i : i + 8]
        at = i + max(k for k, g in enumerate(window) if g == min(window))
        if at not in chosen:
            chosen.append(at)
    return " ".join(f"{grams[at]:x}@{at}" for at in chosen)


def test_winnowing(spark, monkeypatch):
    monkeypatch.setattr(winnow, "SLICE_BYTES", 500)
    rows = [(i, t) for i, t in near_copies() if t] + [(100001, "the same " * 40), (100002, "é\U0001f600 b " * 30), (100003, None), (-4, "x" * 100)]
    rows.sort()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, fingerprint int").repartition(4)
    found = winnow.compare_with_next(docs).select(
        "doc_id", "n_chars", "edited", winnow.written("fingerprint"), winnow.written("edited_fingerprint"), "near_edited", "near_next"
    )
    found = {r[0]: tuple(r)[1:] for r in found.collect()}
    marks = lambda f: {x.split("@")[0] for x in f.split()}
    like = lambda a, b: len(marks(a) & marks(b)) / len(marks(a) | marks(b)) if marks(a) | marks(b) else 1.0
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, new = brute_fingerprint(text), brute_fingerprint(edited)
        assert found[i] == (len(text), edited, own, new, like(own, new), like(own, brute_fingerprint(after))), i


def test_winnowing_guarantee(spark):
    """k + w - 1 = 11 common words give a common chosen hash."""
    draw = random.Random(2)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    passage = [word() for _ in range(11)]
    texts = [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)]) for _ in range(20)]
    rows = winnow.with_fingerprint(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "f")
    sets = [set(r[0]) for r in rows.select(winnow.chosen_hashes("f")).collect()]
    assert all(a & b for a in sets for b in sets)


def test_winnowing_of_texts_without_blanks(spark):
    """A character in front moves no cut but the first; a shared stretch is found wherever it stands."""
    draw = random.Random(12)
    latin = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=2000))
    chinese = "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(800))
    rows = []
    for text in (latin, chinese):
        rows += [text, "x" + text, text[300:], "q7" * 40 + text[200:600] + "w" * 9]
    found = winnow.with_fingerprint(spark.createDataFrame(list(enumerate(rows)), "i int, text string"), "text", "f")
    sets = [set(r[1]) for r in sorted(found.select("i", winnow.chosen_hashes("f")).collect())]
    for first in (0, 4):
        whole = sets[first]
        assert len(whole & sets[first + 1]) >= 0.95 * len(whole) and len(whole & sets[first + 2]) >= 0.9 * len(sets[first + 2])
        assert len(whole & sets[first + 3]) >= 0.6 * len(sets[first + 3])


def test_slices_part_a_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(winnow, "SLICE_BYTES", 2000)
    draw = random.Random(13)
    text = lambda: "".join(draw.choices("abcdef ", k=100))
    docs = spark.createDataFrame([(7, text()) for _ in range(300)] + [(i, text()) for i in range(300)], "doc_id bigint, text string")
    placed = winnow.with_slice(docs.withColumn("_tie", F.xxhash64("text")), "doc_id", "text")
    sizes = {r["_slice"]: r["count"] for r in placed.groupBy("_slice").count().collect()}
    assert len(sizes) >= 25 and max(sizes.values()) <= 60
    rows = sorted((r["doc_id"], r["_tie"], r["_slice"]) for r in placed.collect())
    assert [r[2] for r in rows] == sorted(r[2] for r in rows)
    compared = winnow.compare_with_next(docs).collect()
    nexts = {(r["doc_id"], r["text"]): n["text"] for r, n in zip(*[sorted(placed.collect(), key=lambda r: (r["doc_id"], r["_tie"]))[k:] for k in (0, 1)])}
    edited = {t[: 100 - 50] + n[:50] for (_, t), n in nexts.items()}
    assert len(compared) == 600 and len({r["edited"] for r in compared} - edited) <= 1


def test_winnowing_of_one_and_none(spark):
    one = spark.createDataFrame([(1, "a b c d")], "doc_id bigint, text string")
    row = winnow.compare_with_next(one).first()
    assert (row["edited"], row["near_next"]) == ("a b a b", 1.0)
    assert winnow.compare_with_next(one.limit(0)).count() == 0
    twice = winnow.compare_with_next(one.union(one).union(spark.createDataFrame([(None, "z")], one.schema)))
    assert sorted(repr(r["doc_id"]) for r in twice.collect()) == ["1", "1", "None"]


def test_two_levels_of_slices(spark, monkeypatch):
    monkeypatch.setattr(winnow, "SLICE_BYTES", 40)
    monkeypatch.setattr(winnow, "SLICES", 5)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    sliced = winnow.with_slice(docs, "doc_id", "text").orderBy("doc_id").collect()
    numbers = [r["_slice"] for r in sliced]
    assert numbers == sorted(numbers) and 20 < len(set(numbers)) < 80
    led = winnow.with_next(docs, ["text"]).collect()
    assert {r["doc_id"]: r["next_text"] for r in led} == {i: f"text {(i + 1) % 300}" for i in range(300)}


def brute_nearest(vectors, queries, k=10):
    rows = []
    usable = {i: np.array(v, float) for i, v in vectors if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    for q in queries:
        if q in usable:
            near = sorted((float(np.sqrt(((v - usable[q]) ** 2).sum())), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
            rows += [(q, rank + 1, i, d) for rank, (d, i) in enumerate(near[:k])]
    return rows


@pytest.mark.parametrize("scale", [0.0, 1.0])
def test_forest_recall(spark, scale):
    draw = np.random.default_rng(4)
    data = draw.standard_normal((1500, 16)) + 3 * draw.standard_normal((10, 16))[draw.integers(0, 10, 1500)]
    data *= np.exp(scale * draw.standard_normal((1500, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    found = forest.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, block_rows=400).collect()
    wanted = brute_nearest(rows, range(0, 1500, 20))
    assert len(found) == len(wanted)
    hits = {(r["query_id"], r["vec_id"]) for r in found} & {(q, i) for q, _, i, _ in wanted}
    assert len(hits) >= 0.9 * len(wanted)


def test_forest_odd_vectors(spark):
    hot = [1.0, 2.0]
    rows = [(i, hot) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [float("inf"), 1.0])]
    rows += [(105, [1.0, 2.5]), (106, [1.0, 2.0, 3.0]), (107, []), (0, hot), (20, [9.0, 9.0])]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows if i != 20 or v == hot], "vec_id bigint, embedding array<double>, block int")
    found = sorted(tuple(r) for r in forest.search(docs, F.col("vec_id").isin(0, 20, 100, 101, 105, 106), block_rows=9).collect())
    vectors = {i: v for i, v in rows if i != 20 or v == hot}
    assert found == sorted(brute_nearest(list(vectors.items()), [0, 20, 100, 101, 105, 106]))
    assert forest.search(docs.limit(0), F.col("vec_id") == 0).count() == 0


def test_edited_digest_is_of_utf8(spark):
    row = spark.createDataFrame([("é\U0001f600",)], "t string").select(F.sha2("t", 256)).first()
    assert row[0] == hashlib.sha256("é\U0001f600".encode()).hexdigest()


# ---- memory of workers


def test_join_sends_small_batches_to_workers(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, durable = spark.conf.get(name), jaccard.durable
    monkeypatch.setattr(jaccard, "durable", lambda df: seen.append(spark.conf.get(name)) or durable(df))
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(8)], "doc_id bigint, text string")
    assert {r["component_id"] for r in jaccard.join(docs).collect()} == {0, 2, 4, 6}
    assert seen and set(seen) == {str(jaccard.ARROW_BYTES)} and spark.conf.get(name) == before


def test_batches_are_bounded_and_whole(spark):
    docs = spark.range(3000, numPartitions=1).selectExpr("repeat('x', 1000) AS text").unionByName(spark.sql("SELECT repeat('y', 300000) AS text"))

    def sizes(parts):
        for batch in parts:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    with workspace.arrow_batches(spark, 100_000):
        found = docs.mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(r["n"] for r in found) == 3001
    assert all(r["size"] < 120_000 for r in found if r["n"] > 1) and max(r["size"] for r in found) >= 300_000


def test_a_worker_keeps_the_tables_of_one_operator():
    words.kept("byte bpe test", list)
    words.kept("lowered numbers", words._lowered)
    list(words.released(iter)([]))
    assert "byte bpe test" in sys.modules["_tierflow_kept"].__dict__
    list(words.released(iter, *jaccard.KEPT)([]))
    assert "byte bpe test" not in sys.modules["_tierflow_kept"].__dict__ and "lowered numbers" in sys.modules["_tierflow_kept"].__dict__
