"""Byte-level ids, token files, prefix BPE and packing against the library and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tierflow.llm import byte_bpe, orc_tokens, packing, prefix_bpe, words
from tierflow.workspace import staging_path

ODD = [
    "", "  a  b\n\n c", "It's WE're they'll  'tis 's 'll'd", "a b　 c  ", "\n\n", "日本語 テスト 123４５ ½ x'sabc",
    "'s's", "?'s .'re 're", "x<|endoftext|>y's", "<|startoftext|><|endoftext|>", "a<|endoftext", "é́ ñ\U0001f600 a\U0001f600b", " 's", "\t's \t t",
    "İstanbul ΣΑΣ ß ﬁ Å", "'", "a'", "</w> <w/> a</w>", "naïve " * 400, "z" * 3000,
]
ALPHABET = " \n\t'stremvldS.aA1é ½!İ"


def random_texts(n, seed=0):
    draw = random.Random(seed)
    return ["".join(draw.choices(ALPHABET, k=draw.randint(0, 30))) for _ in range(n)]


def test_hash_index_finds_what_it_holds():
    keys = np.unique(words.mixed(np.arange(5000)))
    index = words.HashIndex(5000)
    index.add(keys[::2], np.arange(len(keys[::2]), dtype=np.int32))
    assert index.get(keys[::2]).tolist() == list(range(len(keys[::2])))
    assert (index.get(keys[1::2]) == -1).all()


def test_blank_separated_words():
    hashes, bounds = words.blank_separated(["A b\x0ba", "", " \t", "a B"])
    assert np.diff(bounds).tolist() == [3, 0, 0, 1]
    assert hashes[0] == hashes[2] != hashes[1]


@pytest.mark.parametrize("module, path", [(byte_bpe, byte_bpe.default_path()), (prefix_bpe, prefix_bpe.default_path())])
def test_ids_are_the_librarys(module, path):
    texts = ODD + random_texts(4000)
    ids, bounds = module.encoder(path).encode(texts)
    wanted = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == wanted[i].ids, text


def test_more_pieces_than_are_kept(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 50)
    library = Tokenizer.from_file(byte_bpe.default_path())
    encoder = byte_bpe.ByteBpe(byte_bpe.default_path())
    for seed in range(5):
        texts = random_texts(100, seed)
        ids, bounds = encoder.encode(texts)
        assert ids.tolist() == [x for e in library.encode_batch(texts, add_special_tokens=False) for x in e.ids]


SCHEMA = "doc_id bigint, text string, part int, ids string"
ROWS = [(5, "b b's", 1, "x"), (None, "n", 1, None), (3, None, 2, ""), (3, "", 2, ""), (9, "long " * 3000, 0, "y"), (5, "b b's", 1, "x"), (5, "a", 1, "x")]


def brute_ids(rows):
    library = Tokenizer.from_file(byte_bpe.default_path())
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark):
    path = staging_path(spark, "test-tokens")
    orc_tokens.write_token_files(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path)
    read = orc_tokens.read_token_files(spark, path)
    rows = sorted(read.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 3, 3, 5, 5, 5, 9]
    start = 0
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        start += r["n_tokens"]
    wanted = sorted((repr(i), crc(ids)) for i, ids in brute_ids(ROWS))
    assert sorted((repr(r["doc_id"]), r["ids_crc32"]) for r in orc_tokens.with_checksums(read).collect()) == wanted
    one = read.where("doc_id = 9")
    assert [r["doc_id"] for r in one.collect()] == [9]
    assert "EqualTo(doc_id,9)" in one._jdf.queryExecution().toString()


def test_files_have_stripes_row_indexes_and_filters(spark, tmp_path):
    """What the footers of the files written say."""
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('some text ', id, ' ', repeat('a b ', 50)) AS text")
    orc_tokens.write_token_files(docs.repartition(2), str(tmp_path / "t"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = 0
    for file in (tmp_path / "t").glob("*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        names = list(reader.getSchema().getFieldNames())
        columns = {reader.getSchema().findSubtype(n).getId(): n for n in names}
        rows += reader.getNumberOfRows()
        assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() >= 1
        opened = reader.rows()
        for stripe in reader.getStripes():
            footer = opened.readStripeFooter(stripe)
            kinds = {}
            for stream in footer.getStreamsList():
                kinds.setdefault(columns.get(stream.getColumn()), set()).add(stream.getKind().toString())
            assert "ROW_INDEX" in kinds["doc_id"] and any("BLOOM_FILTER" in k for k in kinds["doc_id"])
            assert not any("BLOOM_FILTER" in k for k in kinds["ids"])
            # Whole numbers by run lengths of the second version.
            for column in ("doc_id", "n_tokens"):
                number = reader.getSchema().findSubtype(column).getId()
                assert footer.getColumns(number).getKind().toString() == "DIRECT_V2"
        opened.close()
    assert rows == 5000


def test_token_files_of_nothing(spark):
    path = staging_path(spark, "test-tokens")
    orc_tokens.write_token_files(spark.createDataFrame([], SCHEMA), path)
    assert orc_tokens.with_checksums(orc_tokens.read_token_files(spark, path)).count() == 0


def test_prefix_bpe_round_trip(spark):
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(ODD)] + [(99, None, 0, ""), (None, "a", 0, ""), (0, "", 0, "")], SCHEMA)
    library = Tokenizer.from_file(prefix_bpe.default_path())
    wanted = {t: library.encode(t, add_special_tokens=False).ids for t in ODD}
    encoded = prefix_bpe.encode(docs)
    for r in encoded.where("doc_id < 99 AND doc_id > 0").collect():
        assert r["ids"] == wanted[ODD[r["doc_id"]]]
    for r in prefix_bpe.decode(encoded).where("doc_id < 99 AND doc_id > 0").collect():
        assert r["text"] == library.decode(wanted[ODD[r["doc_id"]]], skip_special_tokens=False)
    digests = prefix_bpe.digests(docs)
    assert digests.count() == len(ODD) + 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digest = lambda t: (
        len(ids := library.encode(t, add_special_tokens=False).ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
    )
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    for found, own in ((digests.where("doc_id > 0 AND doc_id < 99"), lambda i: ODD[i]), (prefix_bpe.digests(table), texts.get)):
        for r in found.collect():
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digest(own(r["doc_id"])), own(r["doc_id"])
    assert {r["n_tokens"] for r in digests.where("doc_id = 99 OR doc_id = 0").collect()} == {0}
    assert prefix_bpe.digests(docs.limit(0)).count() == 0


def check_packing(rows, packed, capacity):
    """Every document in full, pieces as agreed, sequences without gaps or overlaps."""
    wanted = []
    for i, ids in brute_ids(rows):
        cut = len(ids) % capacity or capacity
        for piece, a in enumerate([0, *range(cut, len(ids), capacity)]):
            b = cut if piece == 0 else a + capacity
            wanted.append((i, piece, a, b - a, crc(ids[a:b])))
    assert sorted(map(repr, wanted)) == sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in packed)
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        reached = 0
        for offset, length in sorted(places):
            assert offset == reached
            reached += length
        assert reached <= capacity
    return len(sequences)


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    packed = packing.pack(docs).collect()
    assert check_packing(ROWS, packed, 2048) == 2
    assert packing.pack(docs.limit(0)).count() == 0
    small = packing.pack(docs, capacity=7).collect()
    total = sum(len(ids) for _, ids in brute_ids(ROWS))
    assert check_packing(ROWS, small, 7) >= -(-total // 7)


def fewest(items, capacity):
    """The fewest sequences, by trying all."""

    @lru_cache(None)
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        found = len(left)
        for mask in range(1 << len(rest)):
            chosen = [rest[i] for i in range(len(rest)) if mask >> i & 1]
            if first + sum(chosen) <= capacity:
                others = tuple(rest[i] for i in range(len(rest)) if not mask >> i & 1)
                found = min(found, 1 + best(others))
        return found

    return best(tuple(sorted(items, reverse=True)))


def check_reduction(items, capacity):
    """The reduction keeps every piece and the fewest possible sequences."""
    fixed, rest = packing.reduce_dominated(dict(Counter(items)), capacity)
    taken = Counter()
    for times, found in fixed:
        assert sum(found) <= capacity
        taken.update({x: n * times for x, n in Counter(found).items()})
    assert taken + Counter(rest) == Counter(items)
    left = [x for x, n in rest.items() for _ in range(n)]
    assert sum(times for times, _ in fixed) + fewest(left, capacity) == fewest(items, capacity)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
@example([1, 1, 2])
def test_dominance_never_costs_a_sequence(items):
    check_reduction(items, 20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(100, 1700), max_size=9))
@example([618, 1618, 198, 297, 386])
def test_dominance_of_long_pieces_never_costs_a_sequence(items):
    check_reduction(items, packing.CAPACITY)


def test_reduction_is_not_worse_than_best_fit_alone():
    draw = random.Random(1)
    sequences = lambda patterns: sum(times for times, _ in patterns)
    for _ in range(2000):
        low, high = draw.choice([(300, 1100), (1, 2048), (500, 1500), (100, 700), (600, 1400)])
        counts = Counter(draw.randint(low, high) for _ in range(draw.randint(3, 40)))
        fixed, rest = packing.reduce_dominated(counts, 2048)
        assert sequences(fixed) + sequences(packing.best_fit(rest, 2048)) <= sequences(packing.best_fit(counts, 2048))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 60), max_size=20))
def test_best_fit_by_counts_is_best_fit(counts):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [r for r in rooms if r >= length]
            room = min(fitting) if fitting else 30
            if fitting:
                rooms.remove(room)
            rooms.append(room - length)
    patterns = packing.best_fit(counts, 30)
    assert sorted(30 - sum(x * n for x, n in content) for times, content in patterns for _ in range(times)) == sorted(rooms)
