"""Exact quantiles without one reducer that holds a whole column.

The built-in exact percentile gathers all distinct values in one task. Beyond SMALL rows an approximate
sketch, merged from all tasks, brackets the wanted ranks instead; the rows in the bracket, a few
thousandths of all, are counted by value and the ranks read off exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import written

#: Up to so many rows the built-in function does; beyond, the sketch's error in ranks as a share of the rows.
SMALL, ERROR = 1_000_000, 0.0005


def quantile(df: DataFrame, col: str, p: float, small: int | None = None) -> float | None:
    """The linearly interpolated p-quantile of the values that are not null; null for none."""
    values = df.select(F.col(col).cast("double").alias("x")).where("x is not null")
    n = values.count()
    if n <= (SMALL if small is None else small):
        return values.agg(F.percentile("x", F.lit(float(p))).alias("q")).first()["q"]
    at = p * (n - 1)
    ranks = [math.floor(at), min(math.floor(at) + 1, n - 1)]
    lo, hi = values.approxQuantile("x", [max(0.0, p - 3 * ERROR), min(1.0, p + 3 * ERROR)], ERROR)
    lo, hi = (-math.inf if p <= 4 * ERROR else lo), (math.inf if p >= 1 - 4 * ERROR else hi)
    below = values.where(F.col("x") < lo).count()
    inside = values.where((F.col("x") >= lo) & (F.col("x") <= hi)).groupBy("x").count().orderBy("x")
    found, seen = [], below
    for r in inside.toLocalIterator():  # values of a few thousandths of the rows, at most
        seen += r["count"]
        while len(found) < 2 and ranks[len(found)] < seen:
            found.append(r["x"])
        if len(found) == 2:
            break
    return found[0] + (at - ranks[0]) * (found[1] - found[0])


#: Rows of a bracket that are ordered by one task, accuracy of the sketches, rounds of brackets at most.
INSIDE, ACCURACY, ROUNDS = 100_000, 1000, 12


def grouped_quantiles(df: DataFrame, by: list[str], col: str, points: list[float], inside: int = INSIDE) -> DataFrame:
    """(by, p, value): the linearly interpolated quantiles of the values of each group that are not null or NaN.
    Groups without values give no rows; null keys are a group.

    A sketch of each group, merged from all tasks, brackets the two ranks of each point; rows are met with the
    brackets by a join that can be split, and counted below and inside them. While a bracket holds more than
    ``inside`` rows, its rows are sketched again: a round leaves a few thousandths of them. What is left is
    counted by value and ordered. No task holds a group.
    """
    groups = [F.col(b) for b in by] or [F.lit(0)]  # in structs, in which nulls are equal
    names = [f"quillet_b{i}" for i in range(len(groups))]
    x = F.col("quillet_x")
    rows = df.select(*(F.struct(g.alias("k")).alias(n) for n, g in zip(names, groups, strict=True)), F.col(col).cast("double").alias("quillet_x")).where(x.isNotNull() & ~F.isnan(x))
    p = F.explode(F.array(*(F.lit(float(q)) for q in points)))
    at = F.col("p") * (F.col("n") - 1)
    low = F.floor(at).cast("long")
    state = rows.groupBy(*names).agg(F.count("*").alias("n")).select(*names, "n", p.alias("p"))
    state = state.select(*names, "p", at.alias("at"), low.alias("r0"), F.least(low + 1, F.col("n") - 1).alias("r1"), F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("within"))
    state = written(state)
    keys = [*names, "p"]
    for _ in range(ROUNDS):
        if not (state.agg(F.max("within")).first()[0] or 0) > inside:
            break
        wide, narrow = state.where(F.col("within") > inside), state.where(F.col("within") <= inside)
        met = rows.join(wide, names).where(x.between(F.col("lo"), F.col("hi")))
        # Ranks within the bracket, as shares, three times the sketch's error to either side.
        first, last = ((F.col(r) - F.col("below")) / F.col("within") for r in ("r0", "r1"))
        cuts = F.percentile_approx("quillet_x", F.array(*(F.lit(i / ACCURACY) for i in range(ACCURACY + 1))), F.lit(10 * ACCURACY))
        sketch = met.groupBy(*keys).agg(cuts.alias("cuts"))
        place = lambda share, step: F.greatest(F.lit(0), F.least(F.lit(ACCURACY), (F.floor(share * ACCURACY) + step).cast("int")))
        near = wide.join(sketch, keys).select(*keys, "at", "r0", "r1", F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"), F.col("below").alias("old_below"), F.col("within").alias("old_within"), F.get("cuts", place(first, -2)).alias("lo"), F.get("cuts", place(last, 3)).alias("hi"))
        near = written(near)
        counted = rows.join(near.select(*keys, "lo", "hi", "old_lo", "old_hi"), names).where(x.between(F.col("old_lo"), F.col("old_hi"))).groupBy(*keys).agg(F.count(F.when(x < F.col("lo"), 1)).alias("more"), F.count(F.when(x.between(F.col("lo"), F.col("hi")), 1)).alias("within"))
        new = near.join(counted, keys).withColumn("below", F.col("old_below") + F.col("more"))
        # A sketch that missed its ranks, or a bracket of one value, leaves what there was or ends the search.
        good = (F.col("below") <= F.col("r0")) & (F.col("r1") < F.col("below") + F.col("within"))
        one = good & (F.col("lo") == F.col("hi"))
        kept = new.select(*keys, "at", "r0", "r1", F.when(good, F.col("lo")).otherwise(F.col("old_lo")).alias("lo"), F.when(good, F.col("hi")).otherwise(F.col("old_hi")).alias("hi"), F.when(good, F.col("below")).otherwise(F.col("old_below")).alias("below"), F.when(one, 0).when(good, F.col("within")).otherwise(F.col("old_within")).cast("long").alias("within"))
        state = written(narrow.unionByName(kept))
    values = rows.join(state, names).where(x.between(F.col("lo"), F.col("hi"))).groupBy(*keys, "at", "r0", "r1", "below", "quillet_x").agg(F.count("*").alias("c"))
    seen = F.col("below") + F.sum("c").over(Window.partitionBy(*keys).orderBy("quillet_x").rowsBetween(Window.unboundedPreceding, 0))
    found = values.withColumn("seen", seen).groupBy(*keys).agg(F.min(F.when(F.col("seen") > F.col("r0"), x)).alias("v0"), F.min(F.when(F.col("seen") > F.col("r1"), x)).alias("v1"), F.first(F.col("at") - F.col("r0")).alias("share"))
    value = F.when(F.col("share") == 0, F.col("v0")).otherwise(F.col("v0") + F.col("share") * (F.col("v1") - F.col("v0")))
    return found.select(*(F.col(n)["k"].alias(b) for n, b in zip(names, by)), "p", value.alias("value"))
