"""Exact top-k by inner product: an impact-ordered index, score at a time.

Vectors are integers, floor(scale * x) of each component. Rows are dealt to shards by their ids. In a shard the
index has a posting segment for each quantised impact (the size of a component) and dimension: the rows that
have it there, with the exact component. Queries pass all shards in batches. A batch adds segments by falling
impact, those of one impact by a product of matrices. What a row may still gain is bounded by the norms of the
query and of the row's components not yet added (Cauchy-Schwarz), so after an impact the rows that can be among
the k best are known: those whose bound reaches the k-th best exact score seen. Segments stop when scoring
those rows exactly costs less than the rest of the segments; at the last impact nothing is left to bound.
Nothing but that proof leaves a row out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import save, tidied
from .ann import dimension

#: Rows of a shard: FEW, so that small tables have several, up to MANY of large ones. Queries of a batch.
FEW, MANY, BATCH = 4096, 32768, 128
#: Quantised impacts of a shard: this many classes of like numbers of postings. Dimensions whose postings are
#: added at a time. Scoring a possible member costs about as much as adding an impact to so many rows.
IMPACTS, DIMENSIONS, RESCORE = 6, 256, 32


def widest(dim: int) -> int:
    """The largest component for which no inner product of ``dim`` components passes 62 bits, and that is
    written in 32."""
    return min(2**31 - 1, 2 ** ((62 - max(1, dim).bit_length()) // 2))


def codes(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the vectors of ``dim`` finite components, and which rows have one."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(size == dim) if dim else np.zeros(0, np.int64)
    x = x[(np.cumsum(size) - size)[right][:, None] + np.arange(dim)]
    good = np.isfinite(x).all(axis=1)
    ok = np.zeros(len(column), bool)
    ok[right[good]] = True
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x[good] * scale), -widest(dim), widest(dim)).astype(np.int32), ok


def as_rows(column: pa.Array, dim: int) -> np.ndarray:
    """Binary values of ``dim`` 32-bit components each."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.int32).reshape(len(column), dim)


def quantised(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: float) -> DataFrame:
    """(vec_id, code): an id once, of different vectors the smallest code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, ok = codes(batch.column(1), dim, scale)
            ends = (4 * dim * np.arange(len(q) + 1)).astype(np.int32)
            code = pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(q))])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), code], ["vec_id", "code"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col))
    return rows.mapInArrow(tidied(run), "vec_id long, code binary").groupBy("vec_id").agg(F.min("code").alias("code"))


class Index:
    """The impact-ordered postings of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, impacts: int = IMPACTS):
        order = np.argsort(ids)
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order], np.int64)
        size = np.abs(self.x)
        held = size[size > 0]
        # Impact c holds the components from cut[c] on that lie below cut[c - 1].
        self.cut = np.unique(np.quantile(held, np.arange(impacts) / impacts, method="lower"))[::-1] if len(held) else np.zeros(0, np.int64)
        level = len(self.cut) - np.searchsorted(self.cut[::-1], size, side="right")
        square = self.x.astype(np.float64) ** 2
        #: By impact: postings by dimension as (dimensions, row, place in dimensions, component), and the norms of
        #: what is left before it.
        self.segments: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        self.rest = [np.sqrt(square.sum(axis=1))]
        for c in range(len(self.cut)):
            dims, rows = np.nonzero((level == c).T)
            own = []
            used = np.unique(dims)
            for lo in range(0, len(used), DIMENSIONS):
                some = used[lo : lo + DIMENSIONS]
                of = slice(*np.searchsorted(dims, [some[0], some[-1] + 1]))
                own.append((some, rows[of], np.searchsorted(some, dims[of]), self.x[rows[of], dims[of]]))
            self.segments.append(own)
            self.rest.append(np.sqrt((square * (level > c)).sum(axis=1)))
        self.bound = int(size.max(initial=0)) * self.x.shape[1]

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, row, score) of the k best rows of each query, best first, ties to the smaller id, and how many
        impacts were added. A query's own row is none of them."""
        n, m = len(self.ids), len(q)
        q = q.astype(np.int64)
        most = self.bound * int(np.abs(q).max(initial=0))
        # Sums of integers in the narrowest kind that holds them exactly.
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        real = np.float32 if kind == np.float32 else np.float64
        acc = np.zeros((m, n), kind)
        own = np.searchsorted(self.ids, query_ids)
        mine = np.flatnonzero((own < n) & (self.ids[np.minimum(own, n - 1)] == query_ids))
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        least = np.full(m, -np.inf)  # the k-th best exact score seen
        checked = np.inf
        for c in range(len(self.cut) + 1):
            rest, last = self.rest[c], c == len(self.cut)
            # A check pays when the bounds have halved since the one before.
            if last or (c and rest.mean() <= checked / 2):
                checked = rest.mean()
                slack = 8 * float(np.finfo(real).eps) * (most + float(rest.max(initial=0)) * float(norm.max(initial=0)))
                may = np.outer(norm.astype(real), rest.astype(real))
                may += acc
                may += slack + 1e-3  # roundings
                may[mine, own[mine]] = -np.inf
                if n > k:
                    best = np.argpartition(may, n - k, axis=1)[:, n - k :]
                    seen = self.exact(best.ravel(), np.repeat(np.arange(m), k), q).astype(np.float64).reshape(m, k)
                    seen[np.isneginf(np.take_along_axis(may, best, axis=1))] = -np.inf
                    least = np.maximum(least, seen.min(axis=1) - slack)
                members = (may >= least.astype(real)[:, None]) & (may > -np.inf)
                if last or RESCORE * int(members.sum()) <= (len(self.cut) - c) * n * m:
                    break
            for dims, row, at, value in self.segments[c]:
                block = np.zeros((len(dims), n), kind)
                block[at, row] = value
                acc += q[:, dims].astype(kind) @ block
        query, row = np.nonzero(members)
        score = self.exact(row, query, q)
        order = np.lexsort((self.ids[row], -score, query))
        row, query, score = row[order], query[order], score[order]
        first = np.searchsorted(query, np.arange(m))
        keep = np.arange(len(query)) - first[query] < k
        return query[keep], row[keep], score[keep], c

    def exact(self, row: np.ndarray, query: np.ndarray, q: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """Inner products of pairs, in integers."""
        out = np.zeros(len(row), np.int64)
        for lo in range(0, len(row), block):
            out[lo : lo + block] = np.einsum("ij,ij->i", self.x[row[lo : lo + block]], q[query[lo : lo + block]])
        return out


def answers(dim: int, k: int):
    """For ``mapInArrow`` over rows (shard, is_query, vec_id, code) sorted by the first two: the index of a shard
    is built as its rows pass, its queries are answered in batches as they follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, rows, index = None, [], [], None
        waiting_ids, waiting, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting_ids, waiting, held
            if held and index is not None:
                qi, q = np.concatenate(waiting_ids), np.concatenate(waiting)
                for lo in range(0, len(qi), BATCH):
                    query, row, score, _ = index.top(qi[lo : lo + BATCH], q[lo : lo + BATCH], k)
                    yield pa.RecordBatch.from_arrays([pa.array(qi[lo : lo + BATCH][query]), pa.array(index.ids[row]), pa.array(score)], ["query_id", "vec_id", "score"])
            waiting_ids, waiting, held = [], [], 0

        for batch in batches:
            shards, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own, code = batch.column(2).to_numpy(), as_rows(batch.column(3), dim)
            ends = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(asks) != 0)) + 1), len(shards)]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                if lo == hi:
                    continue
                if shards[lo] != shard:
                    yield from flush()
                    shard, ids, rows, index = shards[lo], [], [], None
                if not asks[lo]:
                    ids.append(own[lo:hi].copy())
                    rows.append(code[lo:hi].copy())
                    continue
                if index is None and ids:
                    index = Index(np.concatenate(ids), np.concatenate(rows))
                    ids, rows = [], []
                waiting_ids.append(own[lo:hi].copy())
                waiting.append(code[lo:hi].copy())
                held += hi - lo
                if held >= 8 * BATCH:
                    yield from flush()
        yield from flush()

    return tidied(run)


def search(rows: DataFrame, asked, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the condition ``asked`` on the column vec_id (a long)
    holds for, its k best other rows by the inner product of floor(scale * x); ties to the smaller id.

    Null ids and vectors that are null, hold a null or non-finite component, or differ from the most frequent
    length take no part; zero vectors do. An id that repeats is one row (of different vectors the smaller code).
    Components whose floor lies beyond about 2**27 (less in over 200 dimensions) count as that bound: no score
    passes 64 bits. Fewer than k others: all of them. An empty table gives no rows; other columns aren't read.
    """
    dim = dimension(rows, vec_col)
    codes_ = save(quantised(rows, id_col, vec_col, dim, scale))
    n, slots = codes_.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // MANY), min(-(-n // FEW), slots))
    deal = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    index = codes_.select(deal.alias("shard"), F.lit(0).alias("is_query"), "vec_id", "code")
    queries = codes_.where(asked).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("is_query"), "vec_id", "code")
    dealt = index.union(queries).repartition(min(2 * shards, 20_000), "shard").sortWithinPartitions("shard", "is_query")
    found = dealt.mapInArrow(answers(dim, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
