"""Sinks. Nothing overwrites what it reads."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def csv_append(df: DataFrame, path: str) -> None:
    """Appends to a folder of CSV parts without headers; the header is one file, written with the first rows.
    Read back by ``csv_appended``."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_header"):
        spark.createDataFrame([(",".join(df.columns),)], "value string").coalesce(1).write.text(f"{path}/_header")
    df.write.mode("append").csv(f"{path}/rows")


def csv_appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(f"{path}/rows")


def rewritten(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], form: str = "json") -> None:
    """Replaces a table by what ``change`` makes of it: written beside it, then swapped, as Spark can't write
    over what it reads."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source = spark.read.format(form).load(path)
    change(source).write.mode("overwrite").format(form).save(f"{path}.next")
    old, new = fs_path(path), fs_path(f"{path}.next")
    fs = old.getFileSystem(conf)
    fs.rename(old, fs_path(f"{path}.last"))
    fs.rename(new, old)
    fs.delete(fs_path(f"{path}.last"), True)


def parquet(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame, name: str = "body") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(name))


def mark_processed(ids: DataFrame, path: str, id_col: str = "youtube_id") -> None:
    """Adds ids to a state table; unprocessed() reads it back without regard to repeats."""
    ids.select(id_col).write.mode("append").parquet(path)


def publish(df: DataFrame, path: str, batch: str) -> bool:
    """Writes the rows of a batch once, whatever happens: an attempt is written to a folder of its own, then an
    empty file in the manifest names batch and attempt. Rows count from then on; a batch that is published isn't
    written again. An attempt that broke off is named nowhere, and of two that race the smaller name counts."""
    spark = df.sparkSession
    if any(b == batch for b, _ in manifest(spark, path)):
        return False
    attempt = uuid.uuid4().hex
    df.write.parquet(f"{path}/rows/{batch}/{attempt}")
    _announce(spark, path, batch, attempt)
    return True


def _announce(spark: SparkSession, path: str, batch: str, attempt: str) -> None:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{batch}.{attempt}")
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(name, True).close()


def manifest(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(batch, attempt) of the batches that are published; one name a batch."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    first: dict[str, str] = {}
    for batch, _, attempt in (n.rpartition(".") for n in sorted(names) if not n.startswith(".")):
        first.setdefault(batch, attempt)
    return list(first.items())


def published(spark: SparkSession, path: str, schema, batch: str | None = None) -> DataFrame:
    """The rows of all published batches, or of one."""
    folders = [f"{path}/rows/{b}/{attempt}" for b, attempt in manifest(spark, path) if batch in (None, b)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
