"""Approximate nearest neighbours: a forest of random-projection trees, one shared priority queue,
exact reranking.

The trees are fitted on a bounded sample; every vector is indexed in all of them. A query takes leaves of
all trees in the order of one queue (by the distance to the worst hyperplane passed on the wrong side).
How many it takes is read from the sample: the fewest that reach a target recall against brute force
there, so clustered vectors need few and random ones many. Vectors of those leaves are compared where
they lie, the best of each task scored pair by pair in double precision, and only these go on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import save

#: Vectors that the trees are fitted on at most; trees; rows that a leaf holds about. A tree is as deep as
#: that needs, but each leaf has LEAST vectors of the sample: beyond 640,000 rows leaves grow.
SAMPLE, TREES, LEAF, LEAST = 20_000, 4, 256, 8
#: The recall that the number of visited leaves is chosen for, and sample queries that it is read from.
RECALL, ASKED = 0.95, 300
#: Rows of one leaf and queries that are compared as one block.
BLOCK = 4096
#: What products of matrices may be off by: nearer ties are told by pairwise products.
SLACK = 1e-9


def dimension(df: DataFrame, vec_col: str) -> int:
    """The most frequent number of components, the smaller of equally frequent ones; none: 0."""
    size = df.select(F.size(vec_col).alias("d")).where(F.col("d") > 0).groupBy("d").count()
    got = size.orderBy(F.desc("count"), "d").first()
    return got["d"] if got else 0


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows have one: of ``dim`` components, none of them null
    or non-finite, not all zero. Scaled by the largest component first, so that no square overflows."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(size == dim) if dim else np.zeros(0, np.int64)
    x = x[(np.cumsum(size) - size)[right][:, None] + np.arange(dim)]
    most = np.abs(x).max(axis=1, initial=0)
    good = np.isfinite(x).all(axis=1) & (most > 0)
    x = x[good] / most[good, None]
    ok = np.zeros(len(column), bool)
    ok[right[good]] = True
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], ok


def as_binary(u: np.ndarray) -> pa.Array:
    """Rows of doubles as one binary value each."""
    ends = (8 * u.shape[1] * np.arange(len(u) + 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(u), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(u, np.float64))])


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float64).reshape(len(column), -1)


def valid(df: DataFrame, id_col: str, vec_col: str, *more: str, dim: int) -> DataFrame:
    """Rows of ids and usable vectors, as (vec_id, unit binary of doubles, *more)."""
    schema = df.select(F.col(id_col).cast("long").alias("vec_id"), F.lit(b"").alias("unit"), *more).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, ok = unit_rows(batch.column(1), dim)
            rest = [batch.column(i).filter(pa.array(ok)) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), as_binary(u), *rest], ["vec_id", "unit", *more])

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col), *more).mapInArrow(run, schema)


def sample_matrix(rows: DataFrame, n: int, limit: int) -> np.ndarray:
    """Unit vectors of about ``limit`` rows, the same on every run."""
    step = max(1, -(-n // limit))
    got = rows.where(F.pmod(F.xxhash64("unit"), F.lit(step)) == 0).orderBy("vec_id", "unit").select("unit").limit(2 * limit).toPandas()["unit"]
    return np.frombuffer(b"".join(map(bytes, got)), np.float64).reshape(len(got), -1) if len(got) else np.zeros((0, 1))


class Forest:
    """Complete binary trees of random hyperplanes, each at the median of its node's sample."""

    def __init__(self, sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth = int(max(0, min(np.ceil(np.log2(max(1.0, n / leaf))), np.floor(np.log2(max(1, len(sample)) / LEAST)))))
        self.trees, dim = trees, sample.shape[1]
        nodes = (1 << self.depth) - 1
        self.w = np.zeros((trees, max(1, nodes), dim))
        self.cut = np.zeros((trees, max(1, nodes)))
        for t in range(trees):
            at = np.zeros(len(sample), np.int64)
            for level in range(self.depth):
                for node in range((1 << level) - 1, (2 << level) - 1):
                    own = sample[at == node]
                    if len(own) >= 2:
                        a, b = own[rng.choice(len(own), 2, replace=False)]
                        w = a - b
                        w = w / (np.linalg.norm(w) or 1.0)
                    else:
                        w = rng.standard_normal(dim)
                        w /= np.linalg.norm(w)
                    self.w[t, node] = w
                    self.cut[t, node] = np.median(own @ w) if len(own) else 0.0
                at = 2 * at + 1 + (np.einsum("ij,ij->i", sample, self.w[t, at]) > self.cut[t, at])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.einsum("ij,ij->i", x, self.w[t, at]) > self.cut[t, at])
            out[:, t] = at - ((1 << self.depth) - 1)
        return out

    def visit(self, q: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The first ``most`` (tree, leaf) pairs in the order of the shared queue."""
        margins = self.w @ q - self.cut
        inner, out = (1 << self.depth) - 1, []
        heap = [(0.0, t, 0) for t in range(self.trees)]
        while heap and len(out) < most:
            far, t, node = heapq.heappop(heap)
            while node < inner:
                m = margins[t, node]
                right = m > 0
                heapq.heappush(heap, (max(far, abs(m)), t, 2 * node + 1 + (not right)))
                node = 2 * node + 1 + right
            out.append((t, node - inner))
        return out

    def order(self, q: np.ndarray) -> np.ndarray:
        """The place of every leaf (tree by tree) in the order in which ``visit`` would take them all."""
        margins = self.w @ q - self.cut
        far = np.zeros((self.trees, 1))
        for level in range(self.depth):
            m = margins[:, (1 << level) - 1 : (2 << level) - 1]
            far = np.stack([np.maximum(far, np.where(m > 0, m, 0)), np.maximum(far, np.where(m > 0, 0, -m))], axis=2).reshape(self.trees, -1)
        out = np.empty(far.size, np.int64)
        out[np.argsort(far.ravel(), kind="stable")] = np.arange(far.size)
        return out

    def budget(self, sample: np.ndarray, k: int, recall: float) -> int:
        """Leaves to visit so that ``recall`` of the k nearest in the sample are met, for sample queries. In
        the whole table the nearest are nearer, so that it reaches more."""
        x = sample[np.unique(np.linspace(0, len(sample) - 1, ASKED).astype(int))]
        leaf = self.leaves(sample) + (np.arange(self.trees) << self.depth)
        met = []
        for q in x:
            s = sample @ q
            s[s > 1 - 1e-12] = -2  # itself and its copies
            best = np.argpartition(-s, min(k, len(s) - 1))[:k]
            met += self.order(q)[leaf[best[s[best] > -2]]].min(axis=1).tolist()
        need = int(np.quantile(met, recall, method="higher")) + 1 if met else 1
        return max(need, min(2 * self.trees, self.trees << self.depth))


def merge_best(best: dict[int, tuple[np.ndarray, np.ndarray]], q: int, ids: np.ndarray, s: np.ndarray, k: int) -> None:
    """Keeps the k best different ids of a query, ties to the smaller id."""
    if q in best:
        ids, s = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], s])
    order = np.lexsort((ids, -s))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)[:k]]
    best[q] = ids[order], s[order]


def search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``df`` found for each row of ``queries``.

    Never the query's own id; ties to the smaller id; all candidates if fewer than k. An id that repeats is
    one result, of its nearest vector. Unusable vectors (null, zero, with null or non-finite components, of
    another length than most) and null ids take no part. Empty tables give no rows.
    """
    spark = df.sparkSession
    dim = dimension(df, vec_col)
    rows = save(valid(df, id_col, vec_col, dim=dim))
    asked = valid(queries, id_col, vec_col, dim=dim)
    n = rows.count()
    sample = sample_matrix(rows, n, SAMPLE)
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = Forest(sample, n)
    most = forest.budget(sample, k, recall)
    shared = spark.sparkContext.broadcast(forest)  # TREES trees of at most SAMPLE / LEAST hyperplanes

    def entries(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = as_matrix(part.column(1))
                if query:
                    leaf = [[t << 32 | b for t, b in f.visit(q, most)] for q in x]
                else:
                    leaf = (f.leaves(x) + (np.arange(f.trees) << 32)).tolist()
                size = [len(b) for b in leaf]
                pick = pa.array(np.repeat(np.arange(part.num_rows), size))
                yield pa.RecordBatch.from_arrays([pa.array([b for own in leaf for b in own], pa.int64()), part.column(0).take(pick), part.column(1).take(pick)], ["leaf", "vec_id", "unit"])

    schema = "leaf long, vec_id long, unit binary"
    index = rows.mapInArrow(lambda b: entries(b, False), schema).withColumn("side", F.lit(0))
    # A leaf that holds many times its share (one frequent vector) is dealt over several blocks.
    sizes = index.groupBy("leaf").count()
    heavy = save(sizes.where(F.col("count") > BLOCK).select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    probe = asked.mapInArrow(lambda b: entries(b, True), schema).withColumn("side", F.lit(1))
    if heavy.limit(1).count():
        blocks = F.coalesce("blocks", F.lit(1))
        index = index.join(heavy, "leaf", "left").withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).drop("blocks")
        probe = probe.join(heavy, "leaf", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    else:
        index, probe = index.withColumn("block", F.lit(0)), probe.withColumn("block", F.lit(0))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        now, ids, x = None, np.zeros(0, np.int64), np.zeros((0, 1))

        def out():
            q = np.repeat(list(best), [len(v[0]) for v in best.values()]) if best else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), *(pa.array(np.concatenate([v[i] for v in best.values()]) if best else np.zeros(0, t)) for i, t in ((0, np.int64), (1, np.float64)))], ["query_id", "vec_id", "score"])

        for batch in batches:
            leaf, block, side = (batch.column(i).to_numpy() for i in (0, 3, 4))
            cuts = [0, *(np.flatnonzero((leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(leaf)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                own, v = part.column(1).to_numpy(), as_matrix(part.column(2))
                if (leaf[a], block[a]) != now:
                    now, ids, x, often = (leaf[a], block[a]), np.zeros(0, np.int64), np.zeros((0, v.shape[1])), 1
                if side[a] == 0:
                    ids, x = np.concatenate([ids, own]), np.concatenate([x, v])
                    often = int(np.unique(ids, return_counts=True)[1].max())
                elif len(ids):
                    # Ids may repeat, up to ``often`` times: so many more rows hold k different ones.
                    keep, s = min(len(ids), (k + 1) * often), v @ x.T
                    top = np.partition(s, len(ids) - keep, axis=1)[:, len(ids) - keep] - SLACK
                    for i, q in enumerate(own.tolist()):
                        at = np.flatnonzero((s[i] >= top[i]) & (ids != q))
                        merge_best(best, q, ids[at], np.clip(np.einsum("ij,j->i", x[at], v[i]), -1, 1), k)
            if len(best) > 200_000:
                yield out()
                best.clear()
        yield out()

    cols = ["leaf", "vec_id", "unit", "block", "side"]
    both = index.select(cols).union(probe.select(cols))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(parts, "leaf", "block").sortWithinPartitions("leaf", "block", "side", "vec_id").mapInArrow(compare, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
