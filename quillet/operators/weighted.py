"""Weighted session analytics: means, percentiles, histograms, cumulative shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import written


def usable(df: DataFrame, x: str, w: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & (F.col(w) > 0)).select(F.col(x).cast("double").alias("x"), F.col(w).cast("double").alias("w"))


def weighted_mean(df: DataFrame, x: str, w: str, by: str) -> DataFrame:
    return df.groupBy(by).agg((F.sum(F.col(x) * F.col(w)) / F.sum(w)).alias("weighted_mean"))


def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (x, w) in order: adds the task's number and its running sum of w."""
    task, before = TaskContext.get().partitionId(), 0.0
    for batch in batches:
        if batch.num_rows:
            sums = before + np.cumsum(batch.column(1).to_numpy())
            before = float(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sums), task, np.int32)), pa.array(sums)], ["x", "w", "part", "inner"])


def cumulative(df: DataFrame, x: str, w: str) -> DataFrame:
    """(x, w, cum, total) of each different x in order, by a scan in one pass: x is sorted in ranges, each range
    sums up on its own, and what comes before it is the sum of the ranges before, one number a range."""
    d = usable(df, x, w).groupBy("x").agg(F.sum("w").alias("w"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = written(d.repartitionByRange(ranges, "x").sortWithinPartitions("x").mapInArrow(running, "x double, w double, part int, inner double"))
    sums = d.groupBy("part").agg(F.max("inner").alias("s"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    before = sums.select("part", (F.sum("s").over(every) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy()).alias("total"))
    return d.join(F.broadcast(before), "part").select("x", "w", (F.col("before") + F.col("inner")).alias("cum"), "total")


def percentiles(df: DataFrame, x: str, w: str, points: list[float]) -> DataFrame:
    """(p, value): the smallest x whose cumulative weight reaches p of the total; no interpolation."""
    c = cumulative(df, x, w)
    last = F.max("x")
    aggs = [F.coalesce(F.min(F.when(F.col("cum") >= F.col("total") * p - 1e-9 * F.col("total"), F.col("x"))), last).alias(f"p{i}") for i, p in enumerate(points)]
    one = c.agg(*aggs)
    return one.select(F.explode(F.array(*(F.struct(F.lit(float(p)).alias("p"), F.col(f"p{i}").alias("value")) for i, p in enumerate(points)))).alias("s")).select("s.p", "s.value")


def shares_below(df: DataFrame, x: str, w: str, limits: list[float]) -> DataFrame:
    d = usable(df, x, w)
    one = d.agg(*[(F.sum(F.when(F.col("x") <= t, F.col("w")).otherwise(0.0)) / F.sum("w")).alias(f"s{i}") for i, t in enumerate(limits)])
    return one.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("at_most"), F.col(f"s{i}").alias("share")) for i, t in enumerate(limits)))).alias("s")).select("s.*")


def histogram(df: DataFrame, x: str, w: str, start: float, width: float, bins: int) -> DataFrame:
    """(bin, density): weights in right-open bins, the last one closed; the area is 1."""
    end = start + width * bins
    d = usable(df, x, w).where((F.col("x") >= start) & (F.col("x") <= end))
    b = F.least(F.floor((F.col("x") - start) / width), F.lit(bins - 1)).cast("int")
    h = d.groupBy(b.alias("bin")).agg(F.sum("w").alias("w"))
    return h.crossJoin(F.broadcast(h.agg(F.sum("w").alias("total")))).select("bin", (F.col("w") / (F.col("total") * width)).alias("density"))
