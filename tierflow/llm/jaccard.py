"""Documents whose sets of word shingles overlap enough, by T-occurrence search over inverted lists.

Documents with equal sets are one class, and classes are what is joined. Two classes link when the Jaccard
likeness of their sets is at least ``SHARE`` percent, so a partner of a set of n shingles has
at least T = ceil(SHARE n / 100) of them.

1. *Pruning.* Each set's smallest hashes, so many that at least L of T common ones must be among them, are counted in one
   shuffle. A set of which fewer than the least possible L are found in another's has no partner. Hashes that
   recur within a batch are folded before the shuffle, so a very common shingle costs one entry a batch.
2. *Lists over all sets.* The remaining sets' shingles form inverted lists. Of a set's lists of two or more, the
   T - 1 longest can be passed over: a partner must be on one of the others, the set's short lists.
3. *Neighbours, first round.* Each short list names its most central set (the largest share of shingles that
   others have too). A set counts on how many of its lists each name stands, and the most frequent is
   verified by binary probes of one sorted set into the other. Groups of copies fall together here,
   by as many pairs as they have members.
4. *DivideSkip, second round.* Short lists that still hold sets of different components are searched. All sets on such lists
   with one central set meet, whole, in a task; many are dealt by likeness of size to blocks, and a task gets two of them. The task
   inverts its sets. For each set, its L longest lists there are set aside; the short ones are merged, counting how often
   each other set occurs; sets that occur T - L times are looked up in the long lists by binary probes, longest last, and are dropped as soon as
   the lists left cannot bring them to the required overlap. Only links between components leave the task.
5. Connected components of all links.

No list is cut and no pair is left out. A shingle is a 64-bit hash and so is a class; different ones are
confused with a probability of about 2**-60 a pair.

Nulls and texts without words have an empty set, link with nothing and are their own component. A repeated row is in the same class.
Rows with one id and different texts are joined by their texts, each row has its own result. Ids must be integers;
a null id counts as larger than all others. An empty table gives no rows. Only the id and the text are read by name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.llm import words
from tierflow.llm.components import connected_components
from tierflow.workspace import arrow_batches, durable, runs_on_executors

runs_on_executors("tierflow.llm.words")
runs_on_executors(__name__)

WORDS = 5
SHARE = 75
#: Part of a set that must be found elsewhere, in the pruning.
NEEDED = 0.25
#: Bytes of text whose pruning entries meet in one task, about seven hundred thousand of them.
BUCKET_BYTES = 8_000_000
#: Sets and shingles of one block, about; a task inverts two blocks.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Ratio of the sizes of neighbouring classes of blocks, a little more than that of two sets that link.
SIZE_STEP = 1.005
#: How many of a set's T lists are set aside as long: T / (1 + MERGED log2(longest)).
MERGED = 0.1
#: Long lists that are probed at once.
PROBED = 64
#: Bytes of an Arrow batch: the JVM and the worker each hold one or two of a task.
ARROW_BYTES = 2 * words.FOLDED_CHARS
#: What a worker keeps for this operator.
KEPT = ("blank classes", "lowered numbers")
MANY = 0xFFFF
COUNTED = ["doc_id", "text_hash", "node", "n", "found", "batch"]


def shingle_sets(texts, size=WORDS):
    """A sorted array of distinct shingle hashes for each text."""
    hashes, bounds = words.blank_separated(texts)
    factor = np.uint64(0x9E3779B97F4A7C15)
    n = max(0, len(hashes) - size + 1)
    rolled = hashes[:n].copy()
    for k in range(1, size):
        rolled = rolled * factor + hashes[k : n + k]
    rolled = words.mixed(rolled)
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if last - first >= size:
            yield np.unique(rolled[first : last - size + 1])
        elif last > first:
            whole = words.mixed(np.uint64([last - first]))
            for word in hashes[first:last]:
                whole = words.mixed(whole * factor + word)
            yield whole
        else:
            yield hashes[:0]


def class_of(shingles):
    """A signed 64-bit number that equal sets share."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def overlap_needed(n, share=SHARE):
    return -(-n * share // 100)


def prefix_length(n, share=SHARE):
    needed = overlap_needed(n, share)
    return n - needed + max(1, int(NEEDED * n))


def least_found(n, share=SHARE):
    """How many of a set's prefix must be found in other prefixes, whatever the partner's size."""
    return max(1, int(NEEDED * overlap_needed(n, share)))


def _entries(buckets, size, share):
    """For ``mapInArrow``: a row for each text and blobs of prefix hashes with their owners, by bucket."""

    def run(parts):
        number = TaskContext.get().partitionId() << 32
        for batch in parts:
            for first, last in words.column_batches(batch.column(1), words.FOLDED_CHARS, MANY - 1):
                yield folded(number, *(column.slice(first, last - first) for column in batch.columns))
                number += 1

    def folded(number, ids, column, text_hashes):
        nodes, sizes, place, prefixes, owners = [], [], {}, [], []
        for texts in words.texts_of(column):
            for shingles in shingle_sets(texts, size):
                node = class_of(shingles)
                nodes.append(node)
                sizes.append(len(shingles))
                if len(shingles) and node not in place:
                    place[node] = len(place)
                    prefixes.append(shingles[: prefix_length(len(shingles), share)])
                    owners.append(len(prefixes[-1]))
        hashes = np.concatenate(prefixes) if prefixes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(owners)), owners)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        begins = np.ones(len(hashes), bool)
        begins[1:] = hashes[1:] != hashes[:-1]
        many = np.zeros(len(hashes), bool)
        many[1:] |= ~begins[1:]
        many[:-1] |= ~begins[1:]
        found = np.bincount(owner[many], minlength=len(place))
        sent = np.flatnonzero(begins)
        hashes, owner = hashes[sent], np.where(many[sent], MANY, owner[sent]).astype(np.uint16)
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        everyone = np.fromiter(place, dtype=np.int64, count=len(place))
        blobs = [(k, hashes[a:b].tobytes(), *words.listed_owners(owner[a:b], everyone, MANY)) for k, a, b in words.runs(bucket)]
        counted = dict(zip(place, found.tolist()))
        shared = [counted.pop(node, 0) for node in nodes]
        n, m = len(nodes), len(blobs)
        in_bucket, *parts = zip(*blobs) if blobs else [()] * 4
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i % buckets for i in range(n)] + list(in_bucket), type=pa.int32()),
                pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
                pa.concat_arrays([text_hashes, pa.nulls(m, text_hashes.type)]),
                pa.array(nodes + [None] * m, type=pa.int64()),
                pa.array(sizes + [None] * m, type=pa.int32()),
                pa.array(shared + [None] * m, type=pa.int64()),
                pa.array([None] * n + [number] * m, type=pa.int64()),
                *(pa.array([None] * n + list(part), type=pa.binary()) for part in parts),
            ],
            names=["bucket", *COUNTED, "hashes", "owners", "nodes"],
        )

    return run


def _counted(table):
    """For ``applyInArrow`` over a bucket: its text rows, and for each batch of texts how many hashes of each class
    others have."""
    is_text = table.column("n").is_valid()
    rows = table.filter(is_text).select(COUNTED)
    rows = rows.append_column("counts", pa.nulls(rows.num_rows, pa.binary()))
    blobs = table.filter(pa.compute.invert(is_text))
    hashes, owners, lists = (blobs.column(c).to_pylist() for c in ("hashes", "owners", "nodes"))
    if not hashes:
        return rows.append_column("nodes", pa.nulls(rows.num_rows, pa.binary()))
    owners = [np.frombuffer(o, np.uint16) for o in owners]
    ends = np.cumsum([len(o) for o in owners])
    hashes = np.frombuffer(b"".join(hashes), np.uint64)
    order = np.argsort(hashes, kind="stable")
    again = hashes[order[1:]] == hashes[order[:-1]]
    shared = np.zeros(len(hashes), bool)
    shared[order[1:]] |= again
    shared[order[:-1]] |= again
    counts = []
    for owner, nodes, end in zip(owners, lists, ends.tolist()):
        theirs = owner[shared[end - len(owner) : end] & (owner != MANY)]
        counts.append(np.bincount(theirs, minlength=len(nodes) // 8).astype(np.int64).tobytes())
    m = len(counts)
    more = {name: pa.nulls(m, rows.schema.field(name).type) for name in COUNTED}
    more["batch"] = blobs.column("batch").combine_chunks()
    return pa.concat_tables(
        [
            rows.append_column("nodes", pa.nulls(rows.num_rows, pa.binary())),
            pa.table({**more, "counts": pa.array(counts, type=pa.binary()), "nodes": pa.array(lists, type=pa.binary())}),
        ]
    )


def _batch_counts(table):
    """For ``applyInArrow`` over a batch: its classes' counts from all buckets, one row a class."""
    nodes, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("nodes", "counts"))
    unique, codes = np.unique(nodes, return_inverse=True)
    summed = np.bincount(codes, counts, len(unique)).astype(np.int64)
    return pa.table({"node": pa.array(unique, type=pa.int64()), "found": pa.array(summed, type=pa.int64())})


def _full_sets(size):
    """For ``mapInArrow``: class, size and sorted hashes of each text."""

    def run(parts):
        for batch in parts:
            for texts in words.texts_of(batch.column(0)):
                sets = list(shingle_sets(texts, size))
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([class_of(s) for s in sets], type=pa.int64()),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                    ],
                    names=["node", "n", "shingles"],
                )

    return run


class Inverted:
    """Inverted lists of sets in ascending order of size, for the hashes that two of them have at least."""

    def __init__(self, sets):
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, codes, found = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = found[codes] > 1
        codes, owner = np.cumsum(found > 1)[codes[often]] - 1, owner[often]
        self.lists = np.split(codes, np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])
        order = np.argsort(codes, kind="stable")
        self.members = owner[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(codes))]).astype(np.int64)
        #: List and member as one number, ascending: what binary probes look into.
        self.keys = codes[order] * len(sets) + self.members

    def merged(self, lists):
        """How often each set is a member of ``lists``."""
        lengths = self.starts[lists + 1] - self.starts[lists]
        places = np.arange(lengths.sum()) + np.repeat(self.starts[lists] - np.cumsum(lengths) + lengths, lengths)
        return np.bincount(self.members[places], minlength=len(self.sizes))

    def probed(self, lists, sets):
        """On how many of ``lists`` each of ``sets`` is, by binary search."""
        wanted = lists[:, None] * len(self.sizes) + sets[None, :]
        places = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[places] == wanted).sum(axis=0)


def divide_skip(index: Inverted, query, allowed, share=SHARE):
    """The sets that ``allowed`` (a mask) has, of ``query``'s size or larger, that link with it.

    A partner of n or more shingles has at least T = ceil(2 share n / (100 + share)) in common.
    """
    sizes, lists = index.sizes, index.lists[query]
    n = int(sizes[query])
    least = -(-2 * share * n // (100 + share))
    if len(lists) < least:
        return np.empty(0, np.int64)
    lengths = index.starts[lists + 1] - index.starts[lists]
    lists = lists[np.argsort(lengths, kind="stable")]
    aside = min(least - 1, int(least / (1 + MERGED * np.log2(lengths.max()))))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    counts = index.merged(short)
    found = np.flatnonzero((counts >= least - aside) & allowed)
    found = found[(found > query) & (share * sizes[found] <= 100 * n)]
    counts, needed = counts[found], -(-share * (n + sizes[found]) // (100 + share))
    for first in range(0, len(long), PROBED):
        open_ = counts + len(long) - first >= needed
        found, counts, needed = found[open_], counts[open_], needed[open_]
        if not len(found):
            break
        counts = counts + index.probed(long[first : first + PROBED], found)
    return found[counts >= needed]


def _linked(share):
    """For ``applyInArrow``: links between different components among a task's sets, as few as join the same components."""

    def run(table):
        n = table.column("n").to_numpy()
        order = np.argsort(n, kind="stable")
        node, component, is_first = (table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("node", "component", "is_first"))
        listed = table.column("shingles").combine_chunks()
        at, flat = listed.offsets.to_numpy(), listed.values.to_numpy().view(np.uint64)
        index = Inverted([flat[at[i] : at[i + 1]] for i in order.tolist()])
        within = table.column("within")[0].as_py()
        component = np.unique(component, return_inverse=True)[1]
        links = []
        for query in range(len(node)):
            allowed = component != component[query]
            if not within:
                allowed &= is_first != is_first[query]
            if not allowed[query + 1 :].any():
                continue
            for other in divide_skip(index, query, allowed, share).tolist():
                if component[other] != component[query]:
                    links.append((int(node[query]), int(node[other])))
                    component[component == component[other]] = component[query]
        return pa.table({"a": pa.array([a for a, _ in links], type=pa.int64()), "b": pa.array([b for _, b in links], type=pa.int64())})

    return run


def _blocks(members: DataFrame, share: int) -> DataFrame:
    """Rows (group, low_class, low, high_class, high, is_first, node): what each task gets of the groups' ``members`` (group, node, n).

    A group is split by classes of size, of which two sets that link are in the same or in neighbouring ones, and those by hash into
    blocks. Every pair of blocks that may hold a link is a task. A small group is one block.
    """
    weight = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    whole = members.groupBy("group").agg(weight.alias("weight")).select("group", (F.col("weight") <= 1).alias("is_small"))
    step = float(np.log(SIZE_STEP * 100 / share))
    classed = members.join(whole, "group").withColumn("class", F.when(F.col("is_small"), 0).otherwise(F.floor(F.ln("n") / step)).cast("int"))
    sizes = classed.groupBy("group", "class").agg(F.ceil(weight).cast("int").alias("parts"))
    sizes = sizes.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("class", "parts"))).alias("parts"))
    split = classed.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.try_element_at("parts", "class")).cast("int"))

    def with_class(difference, pair):
        other = F.try_element_at("parts", F.col("class") + difference)
        return F.when(other.isNotNull(), F.transform(F.sequence(F.lit(0), other - 1), pair))

    task = lambda low_class, low, high_class, high, is_first: F.struct(
        low_class.alias("low_class"), low.alias("low"), high_class.alias("high_class"), high.alias("high"), is_first.alias("is_first")
    )
    c, own = F.col("class"), F.col("own")
    pairs = [
        with_class(0, lambda x: task(c, F.least(own, x), c, F.greatest(own, x), own <= x)),
        with_class(1, lambda x: task(c, own, c + 1, x, F.lit(True))),
        with_class(-1, lambda x: task(c - 1, x, c, own, F.lit(False))),
    ]
    dealt = split.select("group", "node", F.explode(F.flatten(F.array_compact(F.array(*pairs)))).alias("task"))
    return dealt.select("group", "task.*", "node")


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) of classes that link, found by binary probes of the smaller set into the larger."""

    def run(parts):
        for batch in parts:
            kept = []
            lists = [batch.column(c) for c in (2, 3)]
            flat = [x.values.to_numpy().view(np.uint64) for x in lists]
            at = [x.offsets.to_numpy() for x in lists]
            for i in range(batch.num_rows):
                x, y = (flat[k][at[k][i] : at[k][i + 1]] for k in (0, 1))
                if len(x) > len(y):
                    x, y = y, x
                places = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[places] == x).sum())
                kept.append(100 * common >= share * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, type=pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(words.released(run, *KEPT), "a bigint, b bigint")


def _short_lists(sets: DataFrame, share: int) -> DataFrame:
    """Rows (h, node, n, central): the lists of each class that are merged."""
    entries = sets.select("node", "n", F.explode("shingles").alias("h"))
    lengths = entries.groupBy("h").agg(F.count("*").alias("listed")).where("listed > 1")
    owned = entries.join(lengths, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("listed", "h"))).alias("lists"))
    needed = F.ceil(F.col("n") * share / 100).cast("int")
    merged = owned.withColumn("short", F.size("lists") - needed + 1).where("short > 0")
    return merged.select(
        "node", "n", (F.size("lists") / F.col("n")).alias("central"), F.explode(F.slice("lists", 1, F.col("short"))).alias("entry")
    ).select(F.col("entry.h").alias("h"), "node", "n", "central")


def linked_classes(sets: DataFrame, share=SHARE) -> DataFrame:
    """Rows (vertex, component) of the classes that link with another; ``sets`` has node, n and shingles."""
    lists = durable(_short_lists(sets, share))
    sizes_fit = lambda a, b: 100 * F.least(a, b) >= share * F.greatest(a, b)

    centre = F.max(F.struct("central", F.col("node").alias("centre"), F.col("n").alias("centre_n"))).alias("best")
    centres = lists.groupBy("h").agg(centre).select("h", "best.centre", "best.centre_n")
    named = lists.join(centres, "h").where((F.col("node") != F.col("centre")) & sizes_fit(F.col("n"), F.col("centre_n")))
    votes = named.groupBy("node", "centre").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("votes", "centre")).alias("best"))
    first_links = durable(_verified(chosen.select("a", F.col("best.centre").alias("b")), sets, share))
    found = durable(connected_components(first_links))

    members = lists.join(found.withColumnRenamed("vertex", "node"), "node", "left")
    members = durable(members.select("h", "node", "n", F.coalesce("component", "node").alias("component")))
    mixed = members.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("h")
    named = mixed.join(centres, "h").select("h", F.col("centre").alias("group"))
    grouped = durable(members.join(named, "h").select("group", "node", "n", "component").distinct())
    content = sets.select("node", "shingles").join(grouped.select("node", "n", "component").distinct(), "node")
    tasks = _blocks(grouped, share).join(content, "node")
    key = ["group", "low_class", "low", "high_class", "high"]
    within = (F.col("low_class") == F.col("high_class")) & (F.col("low") == F.col("high"))
    second_links = tasks.withColumn("within", within).groupBy(*key).applyInArrow(words.released_group(_linked(share)), "a bigint, b bigint")
    everything = second_links.unionByName(found.select(F.col("vertex").alias("a"), F.col("component").alias("b")))
    return connected_components(everything)


def join(docs: DataFrame, id_column="doc_id", text_column="text", size=WORDS, share=SHARE) -> DataFrame:
    """Rows (doc_id, text_hash, node, n_shingles, class_id, component, component_id), one for each row of ``docs``.

    ``node`` is the class of equal sets, ``class_id`` its smallest id, ``component`` a number of all that links reach, the
    smallest class among it (null for an empty set), ``component_id`` the smallest id there.
    """
    with arrow_batches(docs.sparkSession, ARROW_BYTES):
        return _joined(docs, id_column, text_column, size, share)


def _joined(docs, id_column, text_column, size, share):
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    row = "doc_id bigint, text_hash bigint, node bigint, n int, found bigint, batch bigint"
    schema = f"bucket int, {row}, hashes binary, owners binary, nodes binary"
    entries = rows.mapInArrow(words.released(_entries(buckets, size, share), *KEPT), schema)
    counted = durable(entries.groupBy("bucket").applyInArrow(words.released_group(_counted), f"{row}, counts binary, nodes binary"))
    by_batch = counted.where("batch IS NOT NULL").groupBy("batch").applyInArrow(words.released_group(_batch_counts), "node bigint, found bigint")
    texts_rows = counted.where("n IS NOT NULL")

    classes = texts_rows.select("node", "n", "found", "doc_id").unionByName(by_batch, allowMissingColumns=True).groupBy("node").agg(F.max("n").alias("n"), F.sum("found").alias("found"), F.min("doc_id").alias("class_id"))
    needed = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * share / 100) * NEEDED).cast("int"))
    classes = durable(classes.withColumn("alive", (F.col("n") > 0) & (F.col("found") >= needed)))
    alive = classes.where("alive").select(F.col("class_id").alias("alive_id")).distinct()
    texts = rows.join(alive, F.col("doc_id").eqNullSafe(F.col("alive_id")), "left_semi").select("text")
    sets = texts.mapInArrow(words.released(_full_sets(size), *KEPT), "node bigint, n int, shingles array<bigint>").where("n > 0")
    sets = durable(sets.dropDuplicates(["node"]))

    components = linked_classes(sets, share).withColumnRenamed("vertex", "node")
    joined = classes.select("node", "n", "class_id").join(components, "node", "left")
    joined = joined.withColumn("component", F.coalesce("component", "node"))
    smallest = joined.groupBy("component").agg(F.min("class_id").alias("component_id"))
    by_class = joined.join(smallest, "component").select("node", "class_id", "component", "component_id")
    texts_rows = texts_rows.select("doc_id", "text_hash", "node", F.col("n").cast("bigint").alias("n_shingles"))
    own = F.col("doc_id")
    empty = texts_rows.where("n_shingles = 0").select("*", own.alias("class_id"), F.lit(None).cast("bigint").alias("component"), own.alias("component_id"))
    return texts_rows.where("n_shingles > 0").join(by_class, "node").select(*empty.columns).unionByName(empty)


def keep_one(docs: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (a null one last), then of the smallest hash of the text;
    rows without words all stay."""
    joined = join(docs, id_column, text_column)
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    kept = joined.where("component IS NOT NULL").groupBy("component").agg(F.min(row).alias("row")).select("row.doc_id", "row.text_hash")
    kept = kept.unionByName(joined.where("component IS NULL").select("doc_id", "text_hash"))
    kept = kept.distinct().toDF("_kept_id", "_kept_hash")
    text = F.coalesce(F.col(f"doc.{text_column}"), F.lit(""))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    rows = rows.select("doc", F.col(f"doc.{id_column}").cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"))
    same = F.col("id").eqNullSafe(F.col("_kept_id")) & (F.col("text_hash") == F.col("_kept_hash"))
    rows = rows.join(kept, same, "left_semi")
    wordless = F.regexp_replace(text, r"[\x20\x09-\x0D]", "") == ""
    return rows.where(~wordless).dropDuplicates(["id", "text_hash"]).unionByName(rows.where(wordless)).select("doc.*")
