"""Quality score of whole texts by how much better good text's dictionary compresses them than bad text's.

Two zstandard dictionaries are built, one from text labelled good and one from text labelled bad.
A text is cut into blocks, each block is compressed with either dictionary, and the sums give
the normalised difference (bad - good) / (bad + good), between -1 and 1. Short blocks keep the
dictionaries' say, which a long text's own repetition would drown. Where a text repeats itself within a
block, both sizes are small and their difference says little; so the mean size as a share of the
text stands beside it. A logistic curve through labelled rows other than those of the dictionaries turns
the two into a probability.

Learning reads a bounded sample of the labelled rows (parameters ``sample_rows`` for each dictionary and
for the curve, chosen by a hash of the id; ``sample_blocks`` blocks of each row, spread over its whole text); scoring reads every text
whole. Null texts count as empty, whose measures are 0. Repeated rows get the same score; of
contradicting labels of one id the lowest holds. Where a class has no labelled row, every score is the
share of label 1, or 0.5 without any labels. Only ids, texts and labels are read by name, so other columns may have any name.
"""

from __future__ import annotations

import math
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm import words
from tierflow.workspace import runs_on_executors

runs_on_executors("tierflow.llm.words")
runs_on_executors(__name__)

BLOCK = 256
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: What a worker keeps for this operator.
KEPT = "quality"


def blocks(text, size=BLOCK):
    data = text.encode()
    return [data[i : i + size] for i in range(0, len(data), size)]


def spread(items, most):
    """At most ``most`` items at even distances."""
    if len(items) <= most:
        return items
    return [items[i * len(items) // most] for i in range(most)]


def build_dictionary(samples, size=DICTIONARY_BYTES):
    """Bytes of a dictionary; of samples too few to train on, their text itself."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Scorer:
    """Compressed-size difference of a text under two dictionaries."""

    def __init__(self, good, bad):
        import zstandard

        def compressor(data):
            dictionary = zstandard.ZstdCompressionDict(data)
            dictionary.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(
                dict_data=dictionary, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress

        self.good, self.bad = compressor(good), compressor(bad)

    def measures(self, text):
        """The normalised difference, and the logarithm of the mean compressed share of the text."""
        parts = blocks(text)
        if not parts:
            return 0.0, 0.0
        good = sum(len(self.good(p)) for p in parts)
        bad = sum(len(self.bad(p)) for p in parts)
        return (bad - good) / (bad + good), math.log((bad + good) / 2 / sum(map(len, parts)))


def fit_curve(measures, labels, rounds=100):
    """Weights of the two measures and an offset of the logistic curve, by Newton's method. A slight pull to
    zero and short steps keep separable samples finite."""
    import numpy as np

    x = np.column_stack([np.array(measures, dtype=float).reshape(-1, 2), np.ones(len(labels))])
    y, at, pull = np.array(labels, dtype=float), np.zeros(3), 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (y - p) - pull * at
        hessian = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(3)
        step = np.clip(np.linalg.solve(hessian, gradient), -5, 5)
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in at)


class Model:
    """Two dictionaries and a curve; ``constant`` where there was nothing to tell apart."""

    def __init__(self, good=b"", bad=b"", weights=(0.0, 0.0, 0.0), constant=None):
        self.good, self.bad, self.weights, self.constant = good, bad, weights, constant

    def scores(self, texts):
        if self.constant is not None:
            return [self.constant] * len(texts)
        held = words.kept(KEPT, dict)  # of one model at a time
        if (self.good, self.bad) not in held:
            held.clear()
            held[self.good, self.bad] = Scorer(self.good, self.bad)
        scorer = held[self.good, self.bad]
        of_difference, of_share, offset = self.weights
        at = (of_difference * d + of_share * share + offset for d, share in map(scorer.measures, texts))
        return [1 / (1 + math.exp(-max(-700.0, min(700.0, v)))) for v in at]


def _chosen(labelled, rows, salt):
    """A number of rows by a hash of their id."""
    return labelled.orderBy(F.xxhash64("label_id", F.lit(salt)), "label_id").limit(rows)


def learn(docs: DataFrame, labels: DataFrame, id_column="doc_id", text_column="text", label_column="quality", sample_rows=3000, sample_blocks=16) -> Model:
    """The model from ``labels`` (id, 0 or 1); what may be learnt from is for the caller to filter."""
    labelled = (
        labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1))
        .groupBy(F.col(id_column).alias("label_id"))
        .agg(F.min(label_column).cast("int").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(constant=next((float(label) for label in counts), 0.5))
    # Even hashes go to the dictionaries, odd ones to the curve.
    half = F.pmod(F.xxhash64("label_id", F.lit("half")), F.lit(2))
    picked = _chosen(labelled.where(half == 0).where("label = 1"), sample_rows, "good").unionByName(
        _chosen(labelled.where(half == 0).where("label = 0"), sample_rows, "bad")
    )
    texts = docs.select(F.col(id_column).alias("label_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def of_texts(chosen, run, values):
        """What ``run`` makes of the texts of the chosen ids, at most ``sample_rows`` of a kind: of an id with
        several rows it is the text with the smallest hash that counts."""
        found = texts.join(F.broadcast(chosen), "label_id").select("label", "text", "label_id", F.xxhash64("text").alias("text_hash"))
        kind = texts.schema["label_id"].dataType.simpleString()
        made = found.mapInArrow(words.released(run, KEPT), f"label int, {values}, label_id {kind}, text_hash bigint")
        value = F.struct(*(c for c in made.columns if c not in ("label_id", "text_hash")))
        return [r["value"] for r in made.groupBy("label_id").agg(F.min_by(value, F.col("text_hash")).alias("value")).collect()]

    def sampled(parts):
        for batch in parts:
            samples = [spread(blocks(t), sample_blocks) for texts in words.texts_of(batch.column(1)) for t in texts]
            arrays = [batch.column(0), pa.array(samples, type=pa.list_(pa.binary())), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["label", "samples", "label_id", "text_hash"])

    found = of_texts(picked, sampled, "samples array<binary>")
    samples = {0: [], 1: []}
    # An order that no lost executor changes and that does not put like beside like, which training minds.
    joined = lambda row: b"".join(map(bytes, row["samples"]))
    for row in sorted(found, key=lambda row: (zlib.crc32(joined(row)), joined(row))):
        samples[row["label"]] += [bytes(s) for s in row["samples"]]
    if not samples[0] or not samples[1]:
        return Model(constant=counts[1] / (counts[0] + counts[1]))
    good, bad = build_dictionary(samples[1]), build_dictionary(samples[0])

    def measured(parts):
        scorer = Scorer(good, bad)
        for batch in parts:
            values = list(zip(*(scorer.measures(t) for texts in words.texts_of(batch.column(1)) for t in texts))) or [(), ()]
            columns = [pa.array(list(v), type=pa.float64()) for v in values]
            arrays = [batch.column(0), *columns, *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["label", "difference", "share", "label_id", "text_hash"])

    rows = of_texts(_chosen(labelled.where(half == 1), sample_rows, "curve"), measured, "difference double, share double")
    # An order that no lost executor changes.
    rows.sort(key=lambda r: (r["difference"], r["share"], r["label"]))
    return Model(good, bad, fit_curve([(r["difference"], r["share"]) for r in rows], [r["label"] for r in rows]))


def _probability(model: Model, text):
    @F.arrow_udf("double")
    def probability(column: pa.Array) -> pa.Array:
        words.forget_others(KEPT)
        # A slice of the texts is Python strings at a time.
        scores = [score for texts in words.texts_of(column) for score in model.scores(texts)]
        words.release()
        return pa.array(scores, type=pa.float64())

    return probability(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model, text_column="text", score_column="score") -> DataFrame:
    """``docs`` with the probability that the text is good; a column of that name is replaced."""
    return docs.withColumn(score_column, _probability(model, F.col(text_column)))


def keep_good(docs: DataFrame, model: Model, least: float, text_column="text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, all columns as they are."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    scored = rows.withColumn("score", _probability(model, F.col(f"doc.{text_column}")))
    return scored.where(F.col("score") >= least).select("doc.*")
