"""Shared pieces: durable tables, folds, byte access, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own if unset, with a local master alone."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = getattr(spark.sparkContext, "_quillet_dir", None)
    if known is None:
        known = "file://" + tempfile.mkdtemp(prefix="quillet-")
        spark.sparkContext._quillet_dir = known
    return known


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost
    executors, and is removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillet-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str = "no") -> DataFrame:
    """``df`` with the place of each row in an order that tells all rows apart, from 0: rows are sorted in ranges,
    and a range's first number is the sum of the sizes of those before it, one number a range."""
    rows = df.orderBy(*order).withColumn("quillet_part", F.spark_partition_id()).withColumn("quillet_at", F.monotonically_increasing_id())
    rows = save(rows)
    sizes = sorted(tuple(r) for r in rows.groupBy("quillet_part").count().collect())
    first, total = [], 0
    for part, n in sizes:
        first.append((part, total))
        total += n
    # The upper bits of the running number are the range's.
    starts = df.sparkSession.createDataFrame(first, "quillet_part int, quillet_first long")
    at = F.col("quillet_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), "quillet_part").select((F.col("quillet_first") + at).alias(name), *df.columns)


_kept: dict = {}


def kept(make, path: str):
    """What ``make`` builds of ``path``, kept for later tasks of this worker. A worker keeps one such
    object: it goes when a task asks for another, or releases it."""
    if (make, path) not in _kept:
        release()
        _kept[make, path] = make(path)
    return _kept[make, path]


def release() -> None:
    """Frees what earlier tasks of other operators kept in this worker."""
    _kept.clear()
    tidy()


def tidy() -> None:
    """Hands memory that is free in this worker back to the system: idle workers and the next stage's share an
    executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run):
    """``run`` for ``mapInArrow``, after which the worker's free memory goes back to the system."""

    def out(batches):
        yield from run(batches)
        tidy()

    return out


#: Rows that go to a worker at a time where rows are whole texts, unless the session says otherwise.
ROWS, DEFAULT_ROWS = 2000, "10000"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from here on its session sends ROWS rows at a time to Python, if it has Spark's default: 10,000
    long texts are held several times over on both sides."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, DEFAULT_ROWS) == DEFAULT_ROWS:
        conf.set(key, str(ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col, n: int):
    """crc32 of an id written as text, modulo ``n`` (null id: null)."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def slices(batch: pa.RecordBatch, at: int, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts in column ``at`` have about ``most`` bytes: one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy()) if batch.num_rows else np.zeros(0)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hash of ``key``: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(limit)


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) for the links a-b of one task."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


#: Edges that a task contracts at a time before the rounds.
EDGES = 500_000


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: star edges (a, b), b the smaller, of the components of a task's own edges."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, limit = [], EDGES
    n = 0

    def merge() -> None:
        nonlocal a, b, held, n, limit
        a, b = local_components(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
        held, n, limit = [], 0, max(EDGES, len(a))

    for batch in batches:
        held.append((batch.column(0).to_numpy().copy(), batch.column(1).to_numpy().copy()))
        n += batch.num_rows
        if n >= limit:
            merge()
    if held:
        merge()
    for lo in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + 100_000]), pa.array(b[lo : lo + 100_000])], ["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) as (node, root), root the smallest node.

    Parts of about EDGES edges are contracted to stars in their tasks first; what they share is settled by rounds.
    These alternate the large-star and small-star contractions. Hubs are met by aggregations with partial
    results, and by joins of written tables with one row a node: a small one is broadcast, as its size is
    known, and of a large one adaptive plans can split the hubs' partitions. Every round is written.
    Roots and nodes without links don't appear. Raises if ``max_rounds`` don't suffice.
    """
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e = save(e.coalesce(max(1, -(-e.count() // EDGES))).mapInArrow(contracted, "a long, b long"))
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select("b", "a"))
        low = save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = save(large)
        low = save(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.a", "s.b").where("a <> b").distinct()
        e = save(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
