"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is compressed in blocks with either dictionary; the normalised difference of the two sizes,
with how well the text compresses at all, becomes a calibrated probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fold, small_batches, tidied
from ._learn import Logistic, labelled_texts
from .filters import keep_rows

#: Labelled rows of either class that the model is fitted on at most, and their longest text.
PER_CLASS, LONGEST = 2000, 100_000
DICTIONARY = 48 << 10
BLOCK = 4096
LEVEL = 1
THRESHOLD = 0.7
#: Bytes that either size of a text is drawn by.
SHORT = 100


class Model:
    def __init__(self, good: bytes, bad: bytes):
        self.dicts = [good, bad]
        self.calibrated: Logistic | None = None
        self._open = None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def compressors(self):
        if self._open is None:
            self._open = []
            for d in self.dicts:
                if d:
                    z = zstandard.ZstdCompressionDict(d)
                    z.precompute_compress(level=LEVEL)
                    self._open.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=z, write_content_size=False, write_dict_id=False))
                else:
                    self._open.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
        return self._open

    def features(self, text: bytes) -> list[float]:
        good, bad = self.compressors()
        g = b = 0
        view = memoryview(text)
        for at in range(0, len(text), BLOCK):
            x = view[at : at + BLOCK]
            g += len(good.compress(x))
            b += len(bad.compress(x))
        n = len(text)
        if not n:
            return [0.0] * 7
        # Short texts say little: both measures are drawn to what says nothing.
        d, ratio = (b - g) / (b + g + SHORT), (g + b + SHORT) / (2 * n + 2 * SHORT)
        size = np.log1p(n)
        return [d, d * size, (b - g) / np.sqrt(b + g + SHORT), ratio, np.log(ratio), ratio * size, size]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, 7)
        return self.calibrated(x)


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary trained on blocks of ``texts``; none if there is too little text."""
    blocks = [t[i : i + 2048] for t in texts for i in range(0, len(t), 2048)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICTIONARY] if blocks else b""


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "quality") -> Model:
    """Half of the sample builds the dictionaries, the other half calibrates."""
    s, odds = labelled_texts(docs, labels, label, 4, 2, per_class, LONGEST)
    raw = [t.encode() for t in s["text"]]
    y = s["y"].to_numpy(int)
    for_dict = np.arange(len(s)) % 2 == 0
    model = Model(*(dictionary([t for t, k, own in zip(raw, y, for_dict) if own and k == c]) for c in (1, 0)))
    rest = np.flatnonzero(~for_dict)
    x = np.array([model.features(raw[i]) for i in rest]).reshape(-1, 7)
    model.calibrated = Logistic(x, y[rest].astype(float))
    model.calibrated.w[0] += odds
    return model


def keep(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` with all columns whose text is scored THRESHOLD or more; null text counts as empty.
    A score on the threshold counts as label 1, as in ``score``. Repeated rows are judged alike, columns of any name
    go along, an empty table stays empty."""
    return keep_rows(df, model, lambda m, texts: m.scores([(t or "").encode() for t in texts]) >= THRESHOLD, text_col)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; whole texts; null text counts as empty."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = m.scores([t.as_py() or b"" for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("t"))
    return small_batches(rows).mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")
