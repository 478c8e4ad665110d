"""How far sources of a language differ in their words, from exact count vectors.

1. *Count vectors.* Every document becomes a sparse vector of term counts. As with a ``CountVectorizer`` fitted for each
   language, with ``minDF`` and the largest ``vocabSize``, a language keeps the terms that at least ``min_df`` of its documents have.
2. *Group sums.* Vectors are summed by (language, source, term) as a ``Summarizer`` does, first within each task, where
   at most ``HELD`` sums are kept before they are sent on. Sums of vectors need no vocabulary, so it is applied after them:
   texts are read once, and neither texts nor document vectors are shuffled.
3. *Sparse pairs.* A share p is one plus the smoothed count's part of a billion, in whole numbers. A term that a source lacks
   has its least share z. The distance of sources s and t over all V kept terms is

       V |z_s - z_t|  +  sum over t's terms of (|z_s - p_t| - |z_s - z_t|)  +  sum over s's terms of (|p_s - P_t| - |z_s - P_t|)

   with P_t being p_t or z_t, so that only terms that occur are looked at. Terms are dealt to tasks by hash, and sources in
   blocks of ``BLOCK``; a task adds up its terms' parts for the pairs of two blocks.

The vocabulary is a table. ``CountVectorizer`` itself brings it to the driver and broadcasts it, and its size has no bound.

Null texts, languages and sources count as empty strings; a source without terms is a group all the same, and a language
without kept terms has distances of zero. Repeated rows count each. An empty table gives no rows. Only the named columns are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.llm import words
from tierflow.workspace import durable, runs_on_executors

runs_on_executors("tierflow.llm.words")
runs_on_executors(__name__)

#: A term is a run of letters: A to Z in either case, and all that is not ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: For UTF-8: letters of ASCII are lower-cased, its other characters part terms, all other bytes stay.
PARTED = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
MIN_DF, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Sources of a language that a task compares with each other or with as many others.
BLOCK = 256
#: Counts (language, source, term) of one task, about; terms whose shares are laid out together.
TASK_ROWS, CHUNK = 50_000, 4096
#: Sums that a task keeps.
HELD = 500_000


def _vector_sums(parts):
    """For ``mapInArrow``: sums of the documents' vectors, and in how many documents each term is, by group."""
    counts, documents, held = defaultdict(Counter), defaultdict(Counter), 0

    def summed():
        for lang, source in counts:
            terms = list(counts[lang, source])
            n, df = ([found[lang, source][t] for t in terms] for found in (counts, documents))
            m = len(terms) + 1
            columns = [[lang] * m, [source] * m, [None, *terms], [0, *n], [0, *df]]
            types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, type=t) for c, t in zip(columns, types)]
            arrays[2] = arrays[2].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "df"])

    for batch in parts:
        for first, last in words.column_batches(batch.column(2)):
            part = batch.slice(first, last - first)
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()):
                terms = text.translate(PARTED).split()
                mine, theirs = counts[lang, source], documents[lang, source]
                held -= len(mine)
                mine.update(terms)
                theirs.update(set(terms))
                held += len(mine)
            if held > HELD:
                yield from summed()
                counts.clear()
                documents.clear()
                held = 0
    yield from summed()


def group_sums(docs: DataFrame, text_column="text", lang_column="lang", source_column="source") -> DataFrame:
    """Rows (lang, source, term, n, df): how often a group has a term, and in how many of its documents.

    Each group has one more row, with a null term.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_column).alias("lang"), text(source_column).alias("source"), text(text_column).alias("text"))
    sums = rows.mapInArrow(_vector_sums, "lang string, source string, term string, n bigint, df bigint")
    return sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE (count + 5) / (total + 5 kept)) of columns by name, in whole numbers of any size."""
    exact = "CAST({} AS DECIMAL(27,0))".format
    return F.expr(f"1 + ({exact(count)} + {SMOOTHING}) * {SCALE} div ({exact(total)} + {SMOOTHING} * {exact(kept)})").cast("bigint")


def _pairs(table: pa.Table) -> pa.Table:
    """For ``applyInArrow``: parts of the distances between the sources of two blocks, from one task's terms.

    Rows without a term list the sources; the others are shares that occur.
    """
    number, least, p = (table.column(c).to_numpy() for c in ("number", "z", "p"))
    has_term = table.column("term").is_valid().to_numpy(zero_copy_only=False)
    first_block, second_block = (table.column(c)[0].as_py() for c in ("i", "j"))
    z_of = dict(zip(number[~has_term].tolist(), least[~has_term].tolist()))
    sources = np.array(sorted(z_of), dtype=np.int64)
    z = np.array([z_of[s] for s in sources.tolist()], dtype=np.int64)
    owner = np.searchsorted(sources, number[has_term])
    p = p[has_term]
    terms = table.column("term").filter(pa.array(has_term)).combine_chunks().dictionary_encode().indices.to_numpy()
    in_first = sources // BLOCK == first_block
    in_second = sources // BLOCK == second_block
    total = np.zeros((len(sources), len(sources)), dtype=np.int64)
    order = np.argsort(terms, kind="stable")
    terms, owner, p = terms[order], owner[order], p[order]
    bounds = np.searchsorted(terms, np.arange(0, (terms[-1] if len(terms) else 0) + CHUNK + 1, CHUNK))
    for low, first, last in zip(range(0, len(bounds) * CHUNK, CHUNK), bounds[:-1].tolist(), bounds[1:].tolist()):
        rows, cols, values = terms[first:last] - low, owner[first:last], p[first:last]
        laid = np.broadcast_to(z, (CHUNK, len(sources))).copy()
        laid[rows, cols] = values
        for s in range(len(sources)):
            own = cols == s
            if own.any():
                around = laid[rows[own]]
                mine = values[own][:, None]
                # as s: |p_s - P_t| - |z_s - P_t|; as t: |z_s - p_t| - |z_s - z_t|
                total[s] += (np.abs(mine - around) - np.abs(z[s] - around)).sum(axis=0)
                total[:, s] += (np.abs(z - mine) - np.abs(z - z[s])).sum(axis=0)
    wanted = in_first[:, None] & in_second[None, :] & (sources[:, None] < sources[None, :])
    a, b = np.nonzero(wanted)
    n = len(a)
    return pa.table({
        "lang": pa.array([table.column("lang")[0].as_py()] * n, type=pa.string()),
        "a": pa.array(sources[a]), "b": pa.array(sources[b]), "part": pa.array(total[a, b]),
    })


def _distances(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (lang, a, b, part), a < b, numbers of sources: sums over the terms that occur.

    Both tables say in how many ``buckets`` a language's terms are dealt, and which is the ``last`` block of its sources.
    """
    own = F.floor(F.col("number") / BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("last")))
    columns = ["lang", "term", "number", "z", "p", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    occurring = entries.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    listed = groups.where("buckets > 0").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    listed = listed.withColumns({"term": F.lit(None).cast("string"), "p": F.lit(0).cast("bigint")})
    tasks = [x.withColumn("own", own).withColumn("other", other).select(*columns) for x in (occurring, listed)]
    both = tasks[0].unionByName(tasks[1])
    return both.groupBy("lang", "i", "j", "bucket").applyInArrow(_pairs, "lang string, a bigint, b bigint, part bigint")


def audit(docs: DataFrame, text_column="text", lang_column="lang", source_column="source", min_df=MIN_DF, top=TOP) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part ``pair``: the distance to every other source of the language, the largest first. Part ``term``: the ``top`` kept terms whose
    share in the source exceeds that in the language most.
    """
    sums = durable(group_sums(docs, text_column, lang_column, source_column))
    counted = sums.where("term IS NOT NULL")
    by_term = counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("in_lang"))
    vocabulary = durable(by_term.where(F.col("df") >= min_df).select("lang", "term", "in_lang"))
    kept = durable(counted.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = sums.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["v", "lang_total", "total"])
    by_source = Window.partitionBy("lang").orderBy("source")
    none = F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(0)
    sources = F.count("*").over(Window.partitionBy("lang"))
    groups = durable(groups.withColumns({
        "number": (F.row_number().over(by_source) - 1).cast("bigint"), "z": none,
        "buckets": F.ceil(F.col("v") * sources / TASK_ROWS).cast("int"), "last": F.floor((sources - 1) / BLOCK).cast("int"),
    }))

    shared = kept.join(groups, ["lang", "source"])
    entries = durable(shared.select(
        "lang", "source", "term", "number", "z", "buckets", "last",
        share("n", "total", "v").alias("p"), share("in_lang", "lang_total", "v").alias("q"),
    ))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = entries.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    parts = _distances(groups, entries).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    parts = parts.unionByName(parts.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "part"))
    left = groups.select("lang", "source", "v", F.col("number").alias("a"), F.col("z").alias("z_a"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("z").alias("z_b"))
    # Every ordered pair of a language's sources is a row of the result.
    pairs = left.join(right, "lang").where("a <> b").join(parts, ["lang", "a", "b"], "left")
    value = F.col("v") * F.abs(F.col("z_a") - F.col("z_b")) + F.coalesce("part", F.lit(0))
    pairs = pairs.select("lang", "source", "item", value.cast("bigint").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
