"""Row filters that keep every column: a model's verdict on each text decides."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import release, small_batches, tidied

#: Texts that are judged in one call.
SLICE = 1000


def keep_rows(df: DataFrame, model: Any, accept: Callable[[Any, list[str | None]], np.ndarray], text_col: str = "text") -> DataFrame:
    """Rows of ``df`` whose texts ``accept(model, texts)`` finds true. The model is broadcast: of a bounded
    size. Rows that repeat are judged alike; an empty table stays empty; null texts are given as null. Columns go
    along by their places, so that no name of theirs clashes with one in use here; of several named ``text_col``
    the first is judged."""
    at = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                yield part.filter(pa.array(accept(shared.value, part.column(at).to_pylist()), pa.bool_()))

    return small_batches(df).mapInArrow(tidied(run), df.schema)
