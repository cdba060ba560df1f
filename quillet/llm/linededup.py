"""Boilerplate lines by their site-relative frequency, in DataFrame operations alone.

A line is boilerplate on a host if over ``ratio`` of the host's different pages, and at least
``min_pages`` of them, contain it. Only 128-bit digests of lines are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import save

#: Below the rates of repeated lines in the tables (12 % of a host's pages, then 4 % to 1 %); from there on down
#: licence lines and one-word sentences are as frequent, and MIN_PAGES guards small hosts against chance.
RATIO, MIN_PAGES = 0.01, 5


def _digest(c: Column) -> Column:
    """Two independent 64-bit hashes."""
    return F.struct(F.xxhash64(c).alias("h"), F.xxhash64(F.lit(1), c).alias("g"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_key) of boilerplate lines. Pages of a host with the same text count as one."""
    pages = df.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    pages = pages.select("host", _digest(F.col("t")).alias("page"), F.array_distinct(F.transform(F.filter(lines_of(F.col("t")), lambda x: F.trim(x) != ""), lambda x: _digest(F.trim(x)))).alias("keys"))
    # Equal pages are met by their digest; what comes before is summed in each task.
    once = pages.groupBy("host", "page").agg(F.first("keys").alias("keys"))
    totals = once.groupBy("host").agg(F.count("*").alias("pages"))
    counts = once.select("host", F.explode("keys").alias("line_key")).groupBy("host", "line_key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).select("host", "line_key")


def clean(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All rows and columns of ``df``, boilerplate lines taken out of the text.

    Lines are compared trimmed of blanks; blank lines stay. A null host counts as the empty one; null text
    stays null; repeated rows count as one page and are all cleaned. A page all of whose lines are
    boilerplate stays whole. Adds ``n_dropped`` (long), in place of a column of that name.
    """
    bad = boilerplate(df, host_col, text_col, ratio, min_pages)
    # One row a host: its boilerplate lines are at most 1 / ratio times the lines of a mean page. Written,
    # so that its size is known: if small it is broadcast, else both sides are shuffled and hot hosts split.
    by_host = save(bad.groupBy("host").agg(F.collect_set("line_key").alias("quillet_bad")))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    out = df.withColumn("quillet_host", host).join(by_host.withColumnRenamed("host", "quillet_host"), "quillet_host", "left").drop("quillet_host")
    lines = lines_of(F.col(text_col))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("quillet_bad"), _digest(F.trim(x))))
    out = out.withColumn("quillet_kept", F.when(F.col(text_col).isNotNull() & F.col("quillet_bad").isNotNull(), kept))
    some = F.exists("quillet_kept", lambda x: F.trim(x) != "")
    text = F.when(F.coalesce(some, F.lit(False)), F.array_join("quillet_kept", "\n")).otherwise(F.col(text_col))
    dropped = F.when(F.coalesce(some, F.lit(False)), F.size(lines) - F.size("quillet_kept")).otherwise(0).cast("long")
    return out.withColumn("n_dropped", dropped).withColumn(text_col, text).drop("quillet_bad", "quillet_kept")
