"""Nearest neighbours of a stated set of queries by hash-prefix forests.

All vectors are dealt out into blocks of about ``BLOCK_ROWS``, and the queries into chunks; every chunk meets every block
in a task of its own. A block's forest has ``TREES`` sorted arrays of hash strings of ``BITS`` bits, each bit the side of a random
hyperplane on which a vector, less the block's mean, lies. For a query, all trees start at full length and
ascend together: at each prefix length the vectors that share it with the query in any tree are found by
binary search and measured exactly. The ascent ends when a vector as far as the worst of the nearest found so far
would have been met with a probability of at least ``RECALL``, or with the empty prefix, which all share.
So nothing caps the candidates. Vectors of different lengths get one more coordinate, as large as their lengths vary, so
that the angle follows the distance.

Equal vectors of a block are measured once; of their ids the smallest k + 1 are kept, since others cannot be among
the nearest k. Ties go to the smaller id. The blocks' nearest are merged by a window for each query.

Vectors that are null, zero or hold null or non-finite components take no part; vectors are compared with those of as many
components; rows with the query's id are no candidates, a repeated row counts once; a null id takes no part.
Fewer candidates than k are all returned; an empty table gives no rows. Only the id and the vector are read by name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.workspace import runs_on_executors

runs_on_executors(__name__)

BLOCK_ROWS, CHUNK_QUERIES = 8192, 4096
TREES, BITS, RECALL = 48, 24, 0.97


class Forest:
    """Sorted hash strings of a block's distinct vectors."""

    def __init__(self, vectors, trees=TREES, bits=BITS, seed=1):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        self.mean = vectors.mean(axis=0)
        lengths = np.linalg.norm(vectors - self.mean, axis=1)
        self.extra = 4 * float(lengths.std()) if lengths.std() > 1e-6 * max(1e-300, lengths.mean()) else 0.0
        random = np.random.default_rng(seed)
        self.planes = random.standard_normal((vectors.shape[1] + 1, trees * bits))
        self.lifted = self.lift(vectors)
        codes = self.codes(self.lifted)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def lift(self, vectors):
        return np.concatenate([vectors - self.mean, np.full((len(vectors), 1), self.extra)], axis=1)

    def codes(self, lifted):
        """Hash strings as numbers, first bit highest; a row for each tree."""
        sides = (lifted @ self.planes > 0).reshape(len(lifted), self.trees, self.bits)
        return (sides @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))).T

    def nearest(self, query, ids, own, k, recall=RECALL):
        """[(distance, id)] of the query's nearest; ``ids`` has the ids of each distinct vector, ``own`` is the query's."""
        lifted = self.lift(query[None])
        code = self.codes(lifted)[:, 0]
        met = np.zeros(len(self.vectors), bool)
        low = np.zeros(self.trees, np.int64)
        high = np.zeros(self.trees, np.int64)
        best: list[tuple[float, int, int]] = []
        for length in range(self.bits, -1, -1):
            rest = self.bits - length
            fresh = []
            for tree in range(self.trees):
                first = (code[tree] >> rest) << rest
                a, b = np.searchsorted(self.sorted[tree], (first, first + (1 << rest)))
                if (a, b) != (low[tree], high[tree]):
                    fresh += [self.order[tree, a : low[tree]], self.order[tree, high[tree] : b]] if low[tree] < high[tree] else [self.order[tree, a:b]]
                    low[tree], high[tree] = a, b
            if fresh:
                new = np.unique(np.concatenate(fresh))
                new = new[~met[new]]
                met[new] = True
                found = np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1))
                if len(best) >= k:
                    new, found = new[found <= best[-1][0]], found[found <= best[-1][0]]
                near = np.argsort(found, kind="stable")
                near = near[found[near] <= found[near[min(k, len(near) - 1)]]] if len(near) else near
                more = [(float(found[i]), int(x), int(new[i])) for i in near for x in ids[new[i]] if x != own]
                best = sorted(best + more)[:k]
            if len(best) >= k and self._sure(lifted[0], best[-1][2], length, recall):
                break
        return [(d, x) for d, x, _ in best]

    def _sure(self, lifted, worst, length, recall):
        """Whether a vector at the angle of the worst found shares a prefix of this length in some tree."""
        other = self.lifted[worst]
        scale = np.linalg.norm(lifted) * np.linalg.norm(other)
        angle = math.acos(max(-1.0, min(1.0, float(lifted @ other) / scale))) if scale else math.pi
        return 1 - (1 - (1 - angle / math.pi) ** length) ** self.trees >= recall


def _distinct(vectors, ids, k):
    """(distinct vectors, for each its smallest k + 1 ids)."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = np.ascontiguousarray(vectors[order]), ids[order]
    vectors += 0.0  # -0.0 equals 0.0
    keys = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    lists = [[] for _ in first]
    for g, x in zip(group.tolist(), ids.tolist()):
        if len(lists[g]) <= k and (not lists[g] or lists[g][-1] != x):
            lists[g].append(x)
    return vectors[first], lists


def _searched(k):
    def run(table):
        is_query = table.column("is_query").to_numpy(zero_copy_only=False)
        ids = table.column("vec_id").to_numpy()
        column = table.column("vector").combine_chunks()
        vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
        rows = []
        if is_query.any() and (~is_query).any():
            distinct, lists = _distinct(vectors[~is_query], ids[~is_query], k)
            forest = Forest(distinct)
            for own, query in zip(ids[is_query].tolist(), vectors[is_query]):
                rows += [(own, x, d) for d, x in forest.nearest(query, lists, own, k)]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table({n: pa.array(list(c), type=t) for n, c, t in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()))})

    return run


def search(vectors: DataFrame, is_query: Column, k=10, id_column="vec_id", vector_column="embedding", block_rows=BLOCK_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the rows for which ``is_query`` holds, score being the Euclidean distance."""
    values = F.col(vector_column).cast("array<double>")
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col(id_column).isNotNull() & finite & F.exists(values, lambda v: v != 0)
    rows = vectors.where(usable).select(F.col(id_column).cast("bigint").alias("vec_id"), values.alias("vector"), is_query.alias("asked"))
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("asked"), 1)).alias("asked")).first()
    blocks, chunks = max(1, -(-counts["n"] // block_rows)), max(1, -(-counts["asked"] // CHUNK_QUERIES))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "vector", dealt(blocks).alias("block"), every(chunks).alias("chunk"), F.lit(False).alias("is_query"))
    asked = rows.where("asked").dropDuplicates(["vec_id", "vector"])
    queries = asked.select("vec_id", "vector", every(blocks).alias("block"), dealt(chunks).alias("chunk"), F.lit(True).alias("is_query"))
    tasks = candidates.unionByName(queries).withColumn("dimension", F.size("vector"))
    near = tasks.groupBy("dimension", "block", "chunk").applyInArrow(_searched(k), "query_id bigint, vec_id bigint, score double")
    ranked = near.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
