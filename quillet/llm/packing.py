"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A piece goes to the window it fits best; where
none fits, the fullest window is filled up by a cut, if both parts are long enough, and emitted. At
the end the windows of a partition are merged, then what is left over partitions, level by level.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import compress, repeat
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept, save, small_batches, tidied
from .bpe import ODD_NUMBERS, WHITE, byte_letters

LENGTH, WINDOWS, LEAST_CUT, END = 4096, 32, 32, 2
#: Chunks between blanks, and pretokens, that a worker keeps with their ids, and their letters in all.
STORE, STORE_LETTERS = 500_000, 8_000_000
#: Leftover windows that are merged by one task.
MERGE = 32
#: The public pretoken pattern of the word-end vocabulary, for decimal digits (fixed values).
QUICK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w{WHITE}]|_)+")
SEPARATORS = "\x1c\x1d\x1e\x1f"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them.

    Texts are cut at blanks into chunks; the distinct ones of a batch are looked up in a store of chunks
    met before, and their ids are gathered from one flat array. The store starts anew at STORE entries
    or STORE_LETTERS letters, whichever is met first.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.t = Tokenizer.from_file(path)
        self.t.no_padding()
        self.t.no_truncation()
        # The merges alone, for pretokens that are told here and kept here: without the library's own store.
        self.merges = Tokenizer(self.t.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        if hasattr(self.merges.model, "_resize_cache"):
            self.merges.model._resize_cache(0)
        self.letter = {b: c for c, b in byte_letters().items() if b != 32}
        vocab = self.t.get_vocab()
        self.special = [a.content for a in self.t.get_added_tokens_decoder().values()]
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.last[i] = token.endswith("</w>")
        self.end = np.array([END], "<u4").tobytes()
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.letters = self.used = 0
        self.at = np.zeros(1 << 16, np.int64)  # where the ids of a row begin; those of the next end them
        self.ids = np.zeros(1 << 18, np.uint32)

    def add(self, chunks: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Rows for ``chunks``, whose ids end at ``ends`` in ``ids``."""
        n, more = len(self.row), len(chunks)
        while n + more + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.row.update(zip(chunks, range(n, n + more)))
        self.at[n + 1 : n + more + 1] = self.used + ends
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.letters += sum(map(len, chunks))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``rows`` one after the other, and where each row's end."""
        start = self.at[rows]
        size = self.at[rows + 1] - start
        ends = np.cumsum(size)
        return self.ids[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def learn(self, chunks: list[str]) -> None:
        """Chunks of letters alone are one pretoken; others are cut into theirs. The library encodes many
        unknown pretokens, written in the letters of bytes, in one call; each ends in its one word-end id."""
        whole = list(map(str.isalpha, chunks))
        mixed = list(compress(chunks, map(not_, whole)))
        cut = list(map(QUICK.findall, mixed))
        words = [*compress(chunks, whole), *{w for own in cut for w in own}.difference(self.row, compress(chunks, whole))]
        for at in range(0, len(words), 4000):
            own = words[at : at + 4000]
            told = " ".join(own).encode().decode("latin-1").translate(self.letter)
            ids = np.array(self.merges.encode_batch_fast([told], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(own):
                each = [self.t.encode(w, add_special_tokens=False).ids for w in own]
                ids, ends = np.array([i for e in each for i in e], np.uint32), np.cumsum([len(e) for e in each])
            self.add(own, ids, ends)
        several = [(c, own) for c, own in zip(mixed, cut) if c not in self.row]
        if several:
            ids, ends = self.gather(self.numbers([w for _, own in several for w in own]))
            self.add([c for c, _ in several], ids, ends[np.cumsum([len(own) for _, own in several]) - 1])

    def plain(self, text: str) -> bool:
        """Whether the pretokens of ``text`` can be told here; else the library takes it whole. The four
        separators are blanks to Python alone."""
        if any(s in text for s in SEPARATORS) or any(s in text for s in self.special):
            return False
        return text.isascii() or "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text) and not ODD_NUMBERS.search(text)

    def batch(self, texts: list[str]) -> list[bytes]:
        whole, low = {}, []
        for i, t in enumerate(texts):
            if self.plain(t):
                low.append(t.lower())
            else:
                low.append("")
                whole[i] = np.array(self.t.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.row) > STORE or self.letters > STORE_LETTERS:
            self.clear()
        # Cut at ASCII blanks; a chunk that holds another blank is no single pretoken and is cut there later.
        split = pc.ascii_split_whitespace(pa.array(low, pa.large_string()))
        code = split.flatten().dictionary_encode()
        chunks = code.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.row.get, chunks, repeat(-1)), np.int64, len(chunks))
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            lost = [chunks[i] for i in unknown.tolist()]
            self.learn([c for c in lost if c])
            number[unknown] = [self.row[c] if c else -1 for c in lost]
        each = number[code.indices.to_numpy()]
        size = np.where(each < 0, 0, self.at[each + 1] - self.at[each])
        start = np.r_[0, np.cumsum(size)]
        raw = self.ids[np.repeat(self.at[each] - start[:-1], size) + np.arange(start[-1])].astype("<u4").tobytes()
        cuts = (4 * start[split.offsets.to_numpy() - split.offsets[0].as_py()]).tolist()
        return [whole.get(i, b"") or raw[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens) and hands out rows of full sequences."""

    def __init__(self, first_id: int, length: int = LENGTH, windows: int = WINDOWS):
        self.next_id, self.length, self.most = first_id, length, windows
        self.open: list[tuple[int, list]] = []  # (tokens, pieces), none full
        self.rows: list[tuple] = []

    def emit(self, pieces: list, keep_ids: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset, ids if keep_ids else None))
            offset += n
        self.next_id += 1

    def add(self, doc, ids: bytes, start: int = 0, total: int | None = None) -> None:
        total = len(ids) // 4 if total is None else total
        at, n, size = 0, len(ids) // 4, self.length
        while n - at >= size:
            self.emit([(doc, start + at, ids[4 * at : 4 * (at + size)], total)])
            at += size
        while n > at:
            rest = n - at
            fits = [(size - fill, i) for i, (fill, _) in enumerate(self.open) if fill + rest <= size]
            if fits:
                i = min(fits)[1]
                fill, pieces = self.open[i]
                pieces.append((doc, start + at, ids[4 * at :], total))
                if fill + rest == size:
                    self.emit(pieces)
                    del self.open[i]
                else:
                    self.open[i] = (fill + rest, pieces)
                return
            if len(self.open) < self.most:
                self.open.append((rest, [(doc, start + at, ids[4 * at :], total)]))
                return
            i = max(range(len(self.open)), key=lambda i: (self.open[i][0], -i))
            fill, pieces = self.open.pop(i)
            gap = size - fill
            if gap >= LEAST_CUT and rest - gap >= LEAST_CUT:
                pieces.append((doc, start + at, ids[4 * at : 4 * (at + gap)], total))
                at += gap
            self.emit(pieces)

    def merge(self, last: bool = False) -> None:
        """Open windows run together; full ones go out, the rest as one window with its ids."""
        pieces = [p for _, own in sorted(self.open, key=lambda w: -w[0]) for p in own]
        self.open = []
        fill, now = 0, []
        for doc, start, ids, total in pieces:
            while len(ids) // 4 + fill >= self.length:
                cut = self.length - fill
                now.append((doc, start, ids[: 4 * cut], total))
                self.emit(now)
                ids, start, fill, now = ids[4 * cut :], start + cut, 0, []
            if ids:
                now.append((doc, start, ids, total))
                fill += len(ids) // 4
        if now:
            self.emit(now, keep_ids=not last)

    def take(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.binary()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows, self.rows = self.rows, []
        cols = list(zip(*rows)) if rows else [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", windows: int = WINDOWS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``df`` is tokenised whole (null text: empty) and closed by id 2; repeated ids are
    documents of their own. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = kept(WordEncoder, path), TaskContext.get().partitionId()
        packer = Packer(part << 32, windows=windows)
        for batch in batches:
            for ids, texts in _slices(batch):
                for doc, got in zip(ids, encode.batch(texts)):
                    packer.add(doc, got + encode.end)
                if packer.rows:
                    yield packer.take()
        packer.merge()
        yield packer.take()

    packed = save(small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(tidied(run), SCHEMA))
    out = packed.where("ids is null").drop("ids")
    left = packed.where("ids is not null").withColumn("unit", F.expr("shiftright(sequence_id, 32)"))
    level = 0
    while True:
        level += 1
        groups = left.select("unit").distinct().count()
        last = groups <= MERGE
        key = F.lit(0).cast("long") if last else F.floor(F.col("unit") / MERGE)
        merged = save(left.withColumn("unit", key).groupBy("unit").applyInArrow(_merger(level, last), SCHEMA + ", unit long"))
        out = out.union(merged.where("ids is null").drop("ids", "unit"))
        if last:
            return out
        left = merged.where("ids is not null")


def _merger(level: int, last: bool):
    """Merges the leftover windows of at most MERGE units: MERGE * LENGTH tokens."""

    def run(key, t):
        unit = key[0].as_py()
        packer = Packer((1 << 61) + (level << 55) + (unit << 20))
        rows = sorted(t.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        packer.open = [(0, [(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in rows])]
        packer.merge(last)
        batch = packer.take()
        return pa.Table.from_batches([batch]).append_column("unit", pa.array([unit] * batch.num_rows, pa.int64()))

    return run


def _slices(batch: pa.RecordBatch, most: int = 2_000_000):
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        t = t.as_py() or ""
        ids.append(i)
        texts.append(t)
        size += len(t)
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if texts:
        yield ids, texts
