"""Bigram language model in a log-frequency Bloom filter, and scores of whole texts.

*Counting.* The words and pairs of neighbours of all training texts, a text's end being a word and also what stands before
its first word, are counted within each batch and then by hash buckets over the whole corpus.
So a very common word costs one entry a batch. Word counts stay exact, as a table by bucket.

*Filter.* A count c has level 1 + floor(log2 c). Of each pair all levels up to its own are inserted, so that probing level
after level until one is missing gives the quantised count. Each bucket has a block of the filter, sized by the bucket's own
levels so that at most half its bits are set: the filter grows with the corpus and nothing is left out. ``FILTER_BITS`` are
its bits at least. Within a bucket pairs are told apart by 32 bits.

*Broadcast.* The frequent pairs, of the highest levels of which there are at most ``FREQUENT_PAIRS``, also lie in a filter of
``BROADCAST_BITS``, which every worker gets with the exact counts of at most ``FREQUENT_WORDS`` frequent words: a bound that
does not grow with the corpus. A worker probes it first. Only what it lacks is asked for.

*Lookup.* Each batch of texts asks the buckets once for the counts of its other distinct words and the levels
of its other distinct pairs; answers and texts, which are read once more, meet by batch.

*Smoothing.* After a word v, of exact count c(v), a pair that the filter holds with level q gets (1 - u) 2**(q - 1) / c(v), any
other u (c(w) + 1) / (N + V + 1), where u is the share of the training corpus's pairs after words of a level such as v's that
are missing or have the lowest level (Good and Turing's estimate). As 2**(q - 1) is the least count of its level, all words
after v get at most 1 together, but for pairs that the filter holds by mistake. After a word that the training texts lack, u is 1.

*Exact part.* The add-one score over single words takes the exact counts.

Words are lower-cased (A-Z) runs between blanks. Null texts count as empty: one token, the end. Repeated rows each count and each
have a result. Without training texts N and V are 0. An empty table gives no rows. Only the id and the text are read by name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm import words
from tierflow.workspace import durable, runs_on_executors

runs_on_executors("tierflow.llm.words")
runs_on_executors(__name__)

#: Bits of all blocks at least; blocks grow beyond as their pairs need.
FILTER_BITS = 1 << 29
#: Probes for each level.
PROBES = 4
#: Part of a block's bits that may be set.
FULL = 0.5
BUCKET_BYTES = 8_000_000
LEAST_BUCKETS = 64
CLASSES, LEVELS = 16, 62
#: What is broadcast: 16 MB of filter in blocks, which hold frequent pairs by more probes, and 16 MB of words.
BROADCAST_BITS, BROADCAST_BLOCKS, BROADCAST_PROBES = 1 << 27, 64, 8
FREQUENT_PAIRS, FREQUENT_WORDS = 1 << 21, 1 << 20
END = np.uint64(0x5F3759DF5F3759DF)


def token_hashes(texts):
    """(hashes of all words and ends, bounds of each text)."""
    hashes, bounds = words.blank_separated(texts)
    return np.insert(hashes, bounds[1:], END), bounds + np.arange(len(bounds))


def pair_hashes(tokens, bounds):
    """Hash of each token together with the one before it, the end before a text's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = END
    return before, words.mixed(before * np.uint64(0x9E3779B97F4A7C15) + tokens)


def bucket_of(hashes, buckets):
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def level_of(counts):
    return np.frexp(counts.astype(np.float64))[1]


#: The least count of each level.
LEVEL_COUNTS = np.array([0.0] + [2.0 ** (q - 1) for q in range(1, LEVELS + 2)])


class Layout:
    """Where the bits of a key's level lie; ``bits`` of all blocks."""

    def __init__(self, buckets, bits=FILTER_BITS, probes=PROBES):
        self.buckets, self.block, self.probes = buckets, max(128, bits // buckets // 64 * 64), probes

    def grown(self, counts):
        """Layout of one bucket's own block, of which all levels of ``counts`` set ``FULL`` at most."""
        bits = -int(level_of(counts).sum()) * PROBES / math.log(1 - FULL)
        return Layout(1, max(self.block, (int(bits) // 64 + 1) * 64))

    def hashed(self, keys, level, is_pair):
        """Two hashes of each key at a level, from which all its probes follow."""
        a = words.mixed((keys & np.uint64(0xFFFFFFFF)) + (np.uint64(level) << np.uint64(33)) + (np.uint64(is_pair) << np.uint64(32)))
        return a & np.uint64(0xFFFFFFFF), (a >> np.uint64(32)) | np.uint64(1)

    def place(self, a, b, probe):
        """The bit of a probe within a block."""
        return ((a + np.uint64(probe) * b) % np.uint64(self.block)).astype(np.int64)

    def block_of(self, keys, counts, is_pair, packed, lowest=1):
        """Insert the levels of keys, from ``lowest`` up to that of their counts, into a block of ``packed`` bits."""
        levels = level_of(counts)
        for level in range(lowest, int(levels.max(initial=0)) + 1):
            a, b = self.hashed(keys[levels >= level], level, is_pair)
            for probe in range(self.probes):
                places = self.place(a, b, probe)
                np.bitwise_or.at(packed, places >> 3, np.uint8(128) >> (places & 7).astype(np.uint8))

    def levels(self, filter_bytes, hashes, is_pair, lowest=1):
        """The level of each hash, 0 where the filter, which has levels from ``lowest`` on, lacks it."""
        base = bucket_of(hashes, self.buckets) * self.block
        found, left = np.zeros(len(hashes), np.int64), np.arange(len(hashes))
        for level in range(lowest, LEVELS + 1):
            a, b = self.hashed(hashes[left], level, is_pair)
            for probe in range(self.probes):
                if not len(left):
                    return found
                at = base[left] + self.place(a, b, probe)
                # Most of what is not there fails the first probes.
                hit = (filter_bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                left, a, b = left[hit], a[hit], b[hit]
            found[left] = level
        return found


def _blobs(kind, hashes, counts, buckets, width):
    """Rows (bucket, kind, hashes, counts) of sorted hashes."""
    for b, first, last in words.runs(bucket_of(hashes, buckets)):
        yield b, kind, hashes[first:last].astype(width).tobytes(), counts[first:last].astype(np.uint32).tobytes()


def _joined(arrays):
    """One array of all; the list is emptied."""
    joined = np.concatenate(arrays)
    arrays.clear()
    return joined


def _counting(buckets):
    """For ``mapInArrow``: counts of the words and pairs of each batch, by bucket."""

    def run(parts):
        for batch in parts:
            for first, last in words.column_batches(batch.column(0), words.FOLDED_CHARS):
                yield counted(batch.column(0).slice(first, last - first))

    def counted(column):
        singles, pairs = [], []
        for texts in words.texts_of(column):
            tokens, bounds = token_hashes(texts)
            singles.append(tokens)
            pairs.append(pair_hashes(tokens, bounds)[1])
        rows = [*_blobs("word", *np.unique(_joined(singles), return_counts=True), buckets, np.uint64)]
        unique, counts = np.unique(_joined(pairs), return_counts=True)
        # Most pairs are met once in a batch; their counts need not be sent.
        rows += _blobs("once", unique[counts == 1], counts[:0], buckets, np.uint32)
        rows += _blobs("pair", unique[counts > 1], counts[counts > 1], buckets, np.uint32)
        columns = zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in columns], names=["bucket", "kind", "hashes", "counts"])

    return run


def _summed(hashes, counts):
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes, counts = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.empty(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def _most_frequent(keys, counts, most):
    """The ``most`` keys of the highest counts, with these."""
    if len(keys) > most:
        chosen = np.argpartition(counts, len(keys) - most)[len(keys) - most :]
        keys, counts = keys[chosen], counts[chosen]
    return keys, counts


def _counted(layout):
    """For ``applyInArrow`` over a bucket: exact word counts, the bucket's block of the filter, and its frequent words and pairs."""
    # Twice a bucket's even share: what of the frequent ones a bucket has beyond is not broadcast but asked for.
    share = lambda total: max(64, 2 * total // layout.buckets)

    def run(table):
        found = {"word": ([], []), "pair": ([], [])}
        for kind, hashes, counts in zip(*(table.column(c).to_pylist() for c in ("kind", "hashes", "counts"))):
            keys = np.frombuffer(hashes, np.uint64 if kind == "word" else np.uint32).astype(np.uint64)
            found["word" if kind == "word" else "pair"][0].append(keys)
            found["word" if kind == "word" else "pair"][1].append(
                np.ones(len(keys), np.int64) if kind == "once" else np.frombuffer(counts, np.uint32).astype(np.int64)
            )
        bucket = table.column("bucket")[0].as_py()
        singles, single_counts = _summed(*found["word"])
        pairs, pair_counts = _summed(*found["pair"])
        own = layout.grown(pair_counts)
        packed = np.zeros(own.block // 8, np.uint8)
        own.block_of(pairs, pair_counts, True, packed)
        top_words, word_counts = _most_frequent(singles, single_counts, share(FREQUENT_WORDS))
        top_pairs, top_counts = _most_frequent(pairs, pair_counts, share(FREQUENT_PAIRS))
        arrays = {
            "hashes": singles, "counts": single_counts.astype(np.int64), "bits": packed,
            "top_words": top_words, "word_counts": word_counts.astype(np.int64),
            "top_pairs": broadcast_keys(top_pairs, bucket, layout.buckets), "pair_counts": top_counts.astype(np.int64),
        }
        return pa.table(
            {
                "bucket": pa.array([bucket], type=pa.int32()),
                "tokens": pa.array([int(single_counts.sum())], type=pa.int64()),
                "distinct": pa.array([len(singles)], type=pa.int64()),
                **{name: pa.array([x.tobytes()], type=pa.binary()) for name, x in arrays.items()},
            }
        )

    return run


def broadcast_keys(keys, bucket, buckets):
    """What tells pairs apart in the broadcast filter: their 32 bits and their bucket, stirred."""
    return words.mixed((keys & np.uint64(0xFFFFFFFF)) + (np.asarray(bucket, dtype=np.uint64) << np.uint64(32)))


class Frequent:
    """What every worker holds: exact counts of frequent words, and a filter of the levels of frequent pairs from ``lowest`` on."""

    def __init__(self, hashes, counts, bits, lowest):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.bits, self.lowest = hashes[order], counts[order], bits, lowest

    def layout(self):
        return Layout(BROADCAST_BLOCKS, BROADCAST_BITS, BROADCAST_PROBES)

    def word_counts(self, hashes):
        """The count of each word, 0 for other ones."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.counts[place], 0)

    def pair_levels(self, pairs, buckets):
        """The level of each pair, 0 for other ones."""
        keys = broadcast_keys(pairs, bucket_of(pairs, buckets), buckets)
        return self.layout().levels(self.bits, keys, True, self.lowest)


def _least_level(counted: DataFrame, column: str, most: int) -> int:
    """The lowest level from which on there are at most ``most`` counts in the lists of ``column``; at most ``LEVELS`` rows are gathered."""

    def run(parts):
        for batch in parts:
            for counts in batch.column(0).to_pylist():
                levels, n = np.unique(level_of(np.frombuffer(counts, np.int64)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(levels, type=pa.int64()), pa.array(n, type=pa.int64())], names=["level", "n"])

    found = counted.select(column).mapInArrow(run, "level bigint, n bigint").groupBy("level").agg(F.sum("n").alias("n"))
    held, lowest = 0, LEVELS + 1
    for level, n in sorted(((r["level"], r["n"]) for r in found.collect()), reverse=True):
        held += n
        if held > most:
            break
        lowest = level
    return lowest


def _frequent(counted: DataFrame) -> Frequent:
    """The frequent words and pairs of a counted corpus. The driver gets the counts of at most ``FREQUENT_WORDS`` words and
    the blocks of the filter, ``BROADCAST_BITS`` in all."""
    word_level, pair_level = (_least_level(counted, c, n) for c, n in (("word_counts", FREQUENT_WORDS), ("pair_counts", FREQUENT_PAIRS)))
    layout = Layout(BROADCAST_BLOCKS, BROADCAST_BITS, BROADCAST_PROBES)

    def chosen(parts):
        """Rows of words (block -1) and of pairs by block, above their least levels."""
        for batch in parts:
            for tops in zip(*(c.to_pylist() for c in batch.columns)):
                words_, word_counts, pairs, pair_counts = (np.frombuffer(x, k) for x, k in zip(tops, (np.uint64, np.int64) * 2))
                kept, enough = level_of(word_counts) >= word_level, level_of(pair_counts) >= pair_level
                rows = [(-1, words_[kept], word_counts[kept])]
                pairs, pair_counts = pairs[enough], pair_counts[enough]
                block = bucket_of(pairs, BROADCAST_BLOCKS)
                order = np.argsort(block, kind="stable")
                pairs, pair_counts = pairs[order], pair_counts[order]
                rows += [(b, pairs[i:j], pair_counts[i:j]) for b, i, j in words.runs(block[order])]
                columns = ([r[0] for r in rows], [r[1].tobytes() for r in rows], [r[2].tobytes() for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["block", "hashes", "counts"])

    def built(table):
        """A block of the filter; the words as they are."""
        block = table.column("block")[0].as_py()
        hashes, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (("hashes", np.uint64), ("counts", np.int64)))
        if block >= 0:
            bits = np.zeros(layout.block // 8, np.uint8)
            layout.block_of(hashes, counts, True, bits, pair_level)
            hashes, counts = bits, counts[:0]
        columns = ([block], [hashes.tobytes()], [counts.tobytes()])
        return pa.table({c: pa.array(x, type=t) for c, x, t in zip(("block", "hashes", "counts"), columns, (pa.int32(), pa.binary(), pa.binary()))})

    schema = "block int, hashes binary, counts binary"
    tops = counted.select("top_words", "word_counts", "top_pairs", "pair_counts").mapInArrow(chosen, schema)
    rows = tops.groupBy("block").applyInArrow(built, schema).collect()
    bits = np.zeros(BROADCAST_BLOCKS * layout.block // 8, np.uint8)
    hashes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for r in rows:
        if r["block"] < 0:
            hashes, counts = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.int64)
        else:
            at = r["block"] * layout.block // 8
            bits[at : at + layout.block // 8] = np.frombuffer(r["hashes"], np.uint8)
    return Frequent(hashes, counts, bits, pair_level)


class Model:
    """Counts of a corpus: the table by bucket of exact word counts and blocks of the filter, and what is broadcast of it."""

    def __init__(self, counts: DataFrame, layout: Layout):
        self.counts, self.layout = counts, layout
        total = counts.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
        self.tokens, self.distinct = total["n"] or 0, total["v"] or 0
        self.frequent = counts.sparkSession.sparkContext.broadcast(_frequent(counts))


COUNTS = (
    "bucket int, tokens bigint, distinct bigint, hashes binary, counts binary, bits binary, "
    "top_words binary, word_counts binary, top_pairs binary, pair_counts binary"
)


def train(docs: DataFrame, text_column="text", filter_bits=FILTER_BITS) -> Model:
    """Count all texts of ``docs``."""
    texts = docs.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    layout = Layout(max(LEAST_BUCKETS, -(-total // BUCKET_BYTES)), filter_bits)
    entries = texts.mapInArrow(_counting(layout.buckets), "bucket int, kind string, hashes binary, counts binary")
    return Model(durable(entries.groupBy("bucket").applyInArrow(_counted(layout), COUNTS)), layout)


def _asked(column):
    """(tokens, bounds and pairs of each slice of texts, all distinct words, all distinct pairs)."""
    slices = []
    for texts in words.texts_of(column):
        tokens, bounds = token_hashes(texts)
        slices.append((tokens, bounds, pair_hashes(tokens, bounds)[1]))
    singles, pairs = (words.distinct(np.concatenate([x[i] for x in slices])) for i in (0, 2))
    return slices, singles, pairs


def _packed(batch):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


ASKED = "bucket int, batch bigint, singles binary, pairs binary"
ANSWERED = "batch bigint, bucket int, counts binary, levels binary"


def _local(frequent, singles, pairs, buckets):
    """Counts and levels that a worker knows itself; 0 is what it has to ask for."""
    return frequent.word_counts(singles), frequent.pair_levels(pairs, buckets)


def _numbered_batches(parts):
    """(number, batch) of each batch of texts; the same numbers whenever the same partition is read."""
    number = TaskContext.get().partitionId() << 32
    for batch in parts:
        for first, last in words.column_batches(batch.column(1), words.FOLDED_CHARS):
            yield number, batch.slice(first, last - first)
            number += 1


def _asking(buckets, frequent):
    """For ``mapInArrow``: what each batch of texts asks of every bucket."""

    def run(parts):
        for number, batch in _numbered_batches(parts):
            yield asked(batch, number)

    def asked(batch, number):
        _, singles, pairs = _asked(batch.column(1))
        counts, levels = _local(frequent.value, singles, pairs, buckets)
        singles, pairs = singles[counts == 0], pairs[levels == 0]
        in_single, in_pair = (np.searchsorted(bucket_of(x, buckets), np.arange(buckets + 1)) for x in (singles, pairs))
        low, rows = pairs.astype(np.uint32), []
        for b in np.flatnonzero((np.diff(in_single) > 0) | (np.diff(in_pair) > 0)).tolist():
            rows.append((b, number, singles[in_single[b] : in_single[b + 1]].tobytes(), low[in_pair[b] : in_pair[b + 1]].tobytes()))
        columns = zip(zip(*rows) if rows else [()] * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in columns], names=["bucket", "batch", "singles", "pairs"])

    return run


def _reading(parts):
    """For ``mapInArrow``: each batch of texts as one row under its number."""
    for number, batch in _numbered_batches(parts):
        yield pa.RecordBatch.from_arrays([pa.array([number], type=pa.int64()), pa.array([_packed(batch)], type=pa.binary())], names=["batch", "texts"])


def _answer(table):
    """For ``applyInArrow`` over a bucket: for each request the counts of its words and the levels of its pairs, in its order."""
    requests = table.filter(table.column("pairs").is_valid())
    model = table.filter(table.column("bits").is_valid())
    joined = lambda name, kind: np.frombuffer(b"".join(requests.column(name).to_pylist()), kind).astype(np.uint64)
    singles, pairs = joined("singles", np.uint64), joined("pairs", np.uint32)
    counts, levels = np.zeros(len(singles), np.int64), np.zeros(len(pairs), np.int64)
    if model.num_rows:
        known = np.frombuffer(model.column("known")[0].as_py(), np.uint64)
        if len(known):
            place = np.minimum(np.searchsorted(known, singles), len(known) - 1)
            counts = np.where(known[place] == singles, np.frombuffer(model.column("known_counts")[0].as_py(), np.int64)[place], 0)
        bits = np.frombuffer(model.column("bits")[0].as_py(), np.uint8)
        levels = Layout(1, len(bits) * 8).levels(bits, pairs, True)

    def split(values, name, width):
        ends = np.cumsum([len(x) // width for x in requests.column(name).to_pylist()])
        return pa.array([x.tobytes() for x in np.split(values, ends)[:-1]], type=pa.binary())

    answers = requests.select(["batch", "bucket"])
    return answers.append_column("counts", split(counts, "singles", 8)).append_column("levels", split(levels.astype(np.uint8), "pairs", 4))


def _scoring(tokens, distinct, buckets, frequent):
    """For ``applyInArrow`` over a batch: a row for each text, from what the worker knows and the answers of all buckets."""
    floor = math.log10(tokens + distinct + 1)

    def run(table):
        held = table.filter(table.column("texts").is_valid()).column("texts").to_pylist()
        answers = table.filter(table.column("levels").is_valid()).sort_by("bucket")
        if len(held) != 1:
            raise ValueError("a batch that was asked for did not come again: its input changed while it was read")
        batch = pa.ipc.open_stream(held[0]).read_all().combine_chunks().to_batches()[0]
        slices, singles, pairs = _asked(batch.column(1))
        exact, found = _local(frequent.value, singles, pairs, buckets)
        told = [np.frombuffer(b"".join(answers.column(c).to_pylist()), kind) for c, kind in (("counts", np.int64), ("levels", np.uint8))]
        for known, answer in zip((exact, found), told):
            open_ = np.flatnonzero(known == 0)
            if len(open_) != len(answer):
                raise ValueError("a batch of texts was not answered as it asked: its input changed while it was read")
            known[open_] = answer
        word_levels, end = level_of(exact), np.searchsorted(singles, END)
        columns = {k: [] for k in ("n", "log", "known", "pair_log", "other_log", "seen", "unseen", "low")}
        for hashes, bounds, in_pairs in slices:
            m = len(bounds) - 1
            owner = np.repeat(np.arange(m), np.diff(bounds))
            sums = lambda x: np.bincount(owner, x, m)  # noqa: B023, E731
            codes = np.searchsorted(singles, hashes)
            before = np.empty_like(codes)
            before[1:] = codes[:-1]
            before[bounds[:-1]] = end
            context = word_levels[before]
            pair = np.where(context > 0, found[np.searchsorted(pairs, in_pairs)], 0)
            seen = pair > 0
            # A pair that the filter holds by mistake may have a higher level than its word has occurrences.
            ratio = np.log10(np.where(seen, np.minimum(1.0, LEVEL_COUNTS[pair] / np.maximum(exact[before], 1)), 1.0))
            single = np.where(seen, 0.0, np.log10(exact[codes] + 1) - floor)
            # A class of levels for the word before; the lowest level counts as nearly unseen.
            cell = owner * CLASSES + np.minimum((context + 1) // 2, CLASSES - 1)
            grid = lambda x: np.bincount(cell[x], minlength=m * CLASSES).reshape(m, CLASSES).tolist()  # noqa: B023, E731
            columns["n"] += np.diff(bounds).tolist()
            columns["log"] += sums(np.log10(exact + 1)[codes]).tolist()
            columns["known"] += sums((exact > 0)[codes]).astype(np.int64).tolist()
            columns["pair_log"] += sums(ratio).tolist()
            columns["other_log"] += sums(single).tolist()
            columns["seen"] += grid(seen)
            columns["unseen"] += grid(~seen)
            columns["low"] += grid(pair <= 1)
        kinds = dict.fromkeys(columns, pa.float64()) | dict.fromkeys(("n", "known"), pa.int64())
        kinds |= dict.fromkeys(("seen", "unseen", "low"), pa.list_(pa.int32()))
        arrays = [batch.column(0), batch.column(2), *(pa.array(columns[c], type=kinds[c]) for c in columns)]
        return pa.Table.from_arrays(arrays, names=["doc_id", "held_out", *columns])

    return run


ROW = (
    "doc_id {kind}, held_out boolean, n bigint, log double, known bigint, pair_log double, "
    "other_log double, seen array<int>, unseen array<int>, low array<int>"
)


def score(docs: DataFrame, model: Model, id_column="doc_id", text_column="text", held_out_column="held_out") -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    ``held_out`` says which rows the model was not trained on; the smoothing is estimated on the others. ``docs`` is read
    twice and must come in the same partitions both times, as a table does; a job that finds otherwise fails.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), F.col(held_out_column).alias("held_out"))
    buckets, frequent = model.layout.buckets, model.frequent
    counts = model.counts.select("bucket", F.col("hashes").alias("known"), F.col("counts").alias("known_counts"), "bits")
    asked = rows.mapInArrow(_asking(buckets, frequent), ASKED).unionByName(counts, allowMissingColumns=True)
    answered = asked.groupBy("bucket").applyInArrow(_answer, ANSWERED)
    read = rows.mapInArrow(_reading, "batch bigint, texts binary").unionByName(answered, allowMissingColumns=True)
    scoring = _scoring(model.tokens, model.distinct, buckets, frequent)
    texts = durable(read.groupBy("batch").applyInArrow(scoring, ROW.format(kind=kind)))

    shares = texts.where(~F.col("held_out")).agg(
        *(F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in ("seen", "unseen", "low") for i in range(CLASSES))
    ).first()
    missing = []
    for i in range(CLASSES):
        n = (shares[f"seen{i}"] or 0) + (shares[f"unseen{i}"] or 0)
        missing.append(min(0.9999, max(0.0001, ((shares[f"low{i}"] or 0) + 0.5) / (n + 1))))
    of = lambda column, weights: F.aggregate(
        F.zip_with(column, F.array(*map(F.lit, weights)), lambda n, w: n * w), F.lit(0.0), lambda a, b: a + b
    )
    smoothing = of("seen", [math.log10(1 - u) for u in missing]) + of("unseen", [0.0, *(math.log10(u) for u in missing[1:])])
    return texts.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("log") - F.col("n") * math.log10(model.tokens + model.distinct + 1)).alias("base_score"),
        (F.col("pair_log") + F.col("other_log") + smoothing).alias("score"),
    )
