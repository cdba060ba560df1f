"""Byte-level BPE by a segment tree over adjacent pair ranks.

For each pretoken a segment tree holds, at its leaves, rank * length + position of every adjacent
pair. The root is therefore the leftmost pair of the lowest rank; a merge changes at most three
leaves, each refreshed on the way to the root, until the root holds no mergeable pair. The trees of
many pretokens of like length are advanced together as the rows of one array.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept, small_batches, tidied

NONE = np.int64(1) << 60
#: White space of the Unicode standard, as the pretoken pattern understands it (fixed values).
WHITE = r"\t-\r \x85\xa0  -     　"
#: The public pretoken pattern of the byte-level vocabulary (fixed values).
EXACT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: The same for texts whose only numbers are decimal digits, which the standard library can tell.
QUICK = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w{WHITE}]|_)+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Pretokens never cross from other characters into white space: what may be cut first.
COARSE = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
ODD_NUMBERS = regex.compile(r"[\p{Nl}\p{No}]")
#: Chunks, and pretokens, that a worker keeps with their ids, and the letters of both; at the bound it starts anew.
STORE, STORE_LETTERS = 500_000, 16_000_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the
    others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


class Vocabulary:
    """Token bytes, pair ranks and added tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        letters = byte_letters()
        vocab = j["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab}
        self.added = {t["content"]: t["id"] for t in j["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = raw[t]
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        self.of_byte = np.zeros(256, np.int64)
        for t, i in vocab.items():
            if len(raw[t]) == 1:
                self.of_byte[raw[t][0]] = i
        pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(j["model"]["merges"]):
            pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        # Open addressing: a pair's code is looked up from its hash on, as far as the first free slot.
        self.mask = (1 << (8 * len(pairs)).bit_length()) - 1
        self.codes = np.full(self.mask + 1, -1, np.int64)
        self.rank = np.zeros(self.mask + 1, np.int64)
        self.merged = np.zeros(self.mask + 1, np.int64)
        for code, (rank, merged) in pairs.items():
            at = self.slot(code)
            while self.codes[at] >= 0:
                at = (at + 1) & self.mask
            self.codes[at], self.rank[at], self.merged[at] = code, rank, merged
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def slot(self, code):
        return ((code * 0x9E3779B1) >> 15) & self.mask

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs stand in the table of merges, and which of them do."""
        code = a << 20 | b
        at = self.slot(code)
        found = self.codes.take(at)
        lost = np.flatnonzero((found != code).ravel() & (found >= 0).ravel())
        while len(lost):
            flat_at, flat_code = at.reshape(-1), code.reshape(-1)
            flat_at[lost] = (flat_at[lost] + 1) & self.mask
            now = self.codes[flat_at[lost]]
            lost = lost[(now != flat_code[lost]) & (now >= 0)]
        return at, self.codes.take(at) == code


def segment_tree_merge(v: Vocabulary, ids: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Ids after all merges. ids: one pretoken a row, padded to a power of two; length: of each row."""
    n, width = ids.shape
    sym = ids.copy()
    cols = np.arange(width)
    live = cols[None, :] < length[:, None]
    nxt = np.broadcast_to(cols + 1, (n, width)).copy()
    prv = np.broadcast_to(cols - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NONE, np.int64)
    if width > 1:
        at, ok = v.pair(sym[:, :-1], sym[:, 1:])
        ok &= cols[None, 1:] < length[:, None]
        tree[:, width : 2 * width - 1] = np.where(ok, v.rank[at] * width + cols[:-1], NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    if width == 1:
        return np.split(sym[live], np.cumsum(live.sum(axis=1))[:-1])
    sym, nxt, prv, alive, tree = sym.ravel(), nxt.ravel(), prv.ravel(), live.ravel(), tree.ravel()

    def refresh(base, node):
        """The way to the root from the changed leaves; each level is set from the one below."""
        while node[0] > 1:
            node = node >> 1
            left = base + 2 * node
            tree[base + node] = np.minimum(tree.take(left), tree.take(left + 1))

    rows = np.flatnonzero(tree[1 :: 2 * width] < NONE)
    while len(rows):
        base, leaf, end = rows * width, rows * (2 * width), length[rows]
        i = tree.take(leaf + 1) % width
        j = nxt.take(base + i)
        at, _ = v.pair(sym.take(base + i), sym.take(base + j))
        merged = v.merged.take(at)
        sym[base + i] = merged
        alive[base + j] = False
        k = nxt.take(base + j)
        nxt[base + i] = k
        inside = k < end
        safe = np.where(inside, k, i)
        at, ok = v.pair(merged, sym.take(base + safe))
        tree[leaf + width + i] = np.where(ok & inside, v.rank.take(at) * width + i, NONE)
        tree[leaf + width + j] = NONE
        prv[(base + k)[inside]] = i[inside]
        before = prv.take(base + i)
        has = before >= 0
        safe = np.where(has, before, i)
        at, ok = v.pair(sym.take(base + safe), merged)
        value = np.where(ok, v.rank.take(at) * width + safe, NONE)
        tree[leaf + width + safe] = np.where(has, value, tree.take(leaf + width + i))
        refresh(np.concatenate([leaf, leaf, leaf]), np.concatenate([safe, i, j]) + width)
        rows = rows[tree.take(leaf + 1) < NONE]
    sym = sym.reshape(n, width)
    return np.split(sym[live], np.cumsum(live.sum(axis=1))[:-1])


def encode_pretokens(v: Vocabulary, words: list[str]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each pretoken."""
    raw = [w.encode() for w in words]
    out: list[bytes] = [b""] * len(words)
    by_width: dict[int, list[int]] = {}
    for i, b in enumerate(raw):
        if b:
            by_width.setdefault(1 << (len(b) - 1).bit_length(), []).append(i)
    for width, members in by_width.items():
        step = max(1, 400_000 // width)
        for at in range(0, len(members), step):
            own = members[at : at + step]
            length = np.array([len(raw[i]) for i in own])
            flat = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in own), np.uint8).reshape(len(own), width)
            for i, ids in zip(own, segment_tree_merge(v, v.of_byte[flat], length)):
                out[i] = ids.astype("<u4").tobytes()
    return out


class Encoder:
    """Encodes and decodes whole texts; keeps the ids of pretokens it has met, up to STORE."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.store: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.letters = 0
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in self.v.added.items()}

    def pretokens(self, text: str) -> list[str]:
        if not text.isascii() and ODD_NUMBERS.search(text):
            return EXACT.findall(text)
        return QUICK.findall(text)

    def learn(self, chunks: list[str]) -> None:
        """Ids of chunks from those of their pretokens."""
        cut = [self.pretokens(c) for c in chunks]
        words = list({w for own in cut for w in own}.difference(self.words))
        self.words.update(zip(words, encode_pretokens(self.v, words)))
        get = self.words.__getitem__
        self.store.update((c, b"".join(map(get, own))) for c, own in zip(chunks, cut))
        self.letters += sum(map(len, chunks)) + sum(map(len, words))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; strings of added tokens in a text stand for those tokens."""
        flat: list = []
        ends = []
        for t in texts:
            if any(a in t for a in self.special):
                for x in self.v.split.split(t):
                    flat += [self.special[x]] if x in self.special else COARSE.findall(x)
            else:
                flat += COARSE.findall(t)
            ends.append(len(flat))
        if max(len(self.store), len(self.words)) > STORE or self.letters > STORE_LETTERS:
            self.store, self.words, self.letters = {}, {}, 0
        got = list(map(self.store.get, flat))
        lost = [i for i, g in enumerate(got) if g is None]
        self.learn(list({flat[i] for i in lost if type(flat[i]) is str}))
        for i in lost:
            w = flat[i]
            got[i] = w if type(w) is bytes else self.store[w]
        return [b"".join(got[a:b]) for a, b in zip([0, *ends], ends)]

    def decode(self, ids: bytes) -> str:
        table = self.v.bytes
        return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def slices(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of a batch, a bounded number of characters at a time (one text at least)."""
    ids, texts, size, at = batch.column(0), [], 0, 0
    for i, t in enumerate(batch.column(1)):
        t = t.as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= most:
            yield ids[at : i + 1], texts
            texts, size, at = [], 0, i + 1
    if texts:
        yield ids[at:], texts


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row; null text counts as empty."""

    def run(batches):
        e = kept(Encoder, path)
        for batch in batches:
            for ids, texts in slices(batch):
                got = e.encode_batch(texts)
                yield pa.RecordBatch.from_arrays([ids, pa.array([np.frombuffer(g, "<u4").astype(np.int32) for g in got], pa.list_(pa.int32())), pa.array([e.decode(g) for g in got])], ["doc_id", "ids", "decoded"])

    return small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(tidied(run), "doc_id long, ids array<int>, decoded string")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip): the same work, ids kept in the task."""

    def run(batches):
        e = kept(Encoder, path)
        for batch in batches:
            for ids, texts in slices(batch):
                got = e.encode_batch(texts)
                back = [e.decode(g) for g in got]
                yield pa.RecordBatch.from_arrays([
                    ids,
                    pa.array([len(g) // 4 for g in got], pa.int64()),
                    pa.array([hashlib.sha256(g).hexdigest() for g in got]),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]),
                    pa.array([a == b for a, b in zip(texts, back)]),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(tidied(run), schema)
