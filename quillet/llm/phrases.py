"""Phrase collocations: dictionary-encoded words, n-grams as fixed-width keys, radix sort and run lengths.

1. Slices of the texts are split into words once; a slice's words have codes of its own, and its words' counts
   go to the corpus counts. Slices are written as codes.
2. Words that occur often enough have a 32-bit id each. A slice gets the ids of its own words by a join: the
   dictionary is broadcast nowhere. Pieces break at all other words, as no phrase of them can be often enough.
3. n-grams of a slice are rows of four ids, most significant first, zeros after a shorter one. They are radix
   sorted and counted as runs before anything leaves the slice, then cut at the limits of the key ranges.
4. A range's keys are radix sorted and counted again; what is often enough stays.

Phrases are scored by joins of their parts' counts, all in decimals where 64 bits could pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import numbered, save, tidied

#: Words of a phrase at most; occurrences of a candidate; share in percent from which a longer one displaces it;
#: the factor of scores; phrases of a language.
WORDS, COUNT, INSIDE, SCALE, BEST = 4, 30, 80, 2_000_000, 2000
#: Bytes of text in a slice, bytes of keys in a range, keys that the ranges' limits are read from: of so many
#: slices at most.
SLICE, RANGE, SAMPLED = 8_000_000, 48_000_000, 24
#: Where pieces end, and what parts words.
ENDS, BLANKS = "[.,;:!?\\x0A-\\x0D]", "\t"
KEY = 4 * WORDS


def pack(a: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(a), asbytes=True)


def unpack(b: bytes, size: int, kind) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(b, size, asbytes=True), kind) if size else np.zeros(0, kind)


# --- 1. slices of words ---------------------------------------------------------------------------------


def encoded(text: pa.Array, lang: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """The words of texts as codes from 1 of their different (language, word), 0 where a piece ends; then the
    languages, words and counts of the codes."""
    if text.nbytes > 1 << 28:
        text = text.cast(pa.large_string())
    t = pc.replace_substring_regex(pc.ascii_lower(text), ENDS, " \n ")
    t = pc.binary_join_element_wise(pc.replace_substring(t, BLANKS, " "), pa.scalar(" \n", t.type), pa.scalar("", t.type))
    words = pc.split_pattern(t, " ")
    langs = lang.dictionary_encode()
    own = np.repeat(langs.indices.to_numpy(), pc.list_value_length(words).to_numpy())
    flat = words.flatten().dictionary_encode()
    code = flat.indices.to_numpy().astype(np.int64)
    mark = lambda w: pc.index(flat.dictionary, pa.scalar(w, flat.dictionary.type)).as_py()
    keep = code != mark("")
    code, own = code[keep], own[keep]
    end = code == mark("\n")
    size = len(flat.dictionary)
    pair = own * np.int64(size) + code
    if len(langs.dictionary) * size <= 30_000_000:
        n = np.bincount(pair[~end], minlength=len(langs.dictionary) * size)
        met = np.flatnonzero(n)
        place = np.zeros(len(n), np.int32)
        place[met] = np.arange(1, len(met) + 1)
        out, n = place[pair], n[met]
    else:
        met, back, n = np.unique(pair[~end], return_inverse=True, return_counts=True)
        out = np.zeros(len(pair), np.int32)
        out[~end] = back + 1
    out[end] = 0
    return out, langs.dictionary.take(pa.array(met // size)), flat.dictionary.take(pa.array(met % size)).cast(pa.string()), n


SLICES = "slice long, code int, lang string, word string, n long, size int, codes binary"


def slice_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the words of a slice, (slice, code, lang, word, n), and one of its codes, (slice, size, codes)."""
    names = [f.split()[0] for f in SLICES.split(", ")]
    task = TaskContext.get().partitionId() << 32
    made, held, size = 0, [], 0

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal made, held, size
        both = pa.Table.from_batches(held).combine_chunks()
        code, lang, word, n = encoded(*(pa.concat_arrays(both.column(i).chunks) for i in (0, 1)))
        at, k = task + made, len(n)
        none = lambda t: pa.nulls(k, t)
        for lo in range(0, k, 100_000):
            part = [pa.array(np.full(k, at)), pa.array(np.arange(1, k + 1, dtype=np.int32)), lang.cast(pa.string()), word, pa.array(n.astype(np.int64)), none(pa.int32()), none(pa.binary())]
            yield pa.RecordBatch.from_arrays([x.slice(lo, 100_000) for x in part], names)
        one = [pa.array([at]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([len(code)], pa.int32()), pa.array([pack(code)], pa.binary())]
        yield pa.RecordBatch.from_arrays(one, names)
        made, held, size = made + 1, [], 0

    for batch in batches:
        length = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy().astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = length[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(length, before + SLICE - size, "right")))
            held.append(batch.slice(lo, hi - lo))
            size += int(length[hi - 1] - before)
            lo = hi
            if size >= SLICE or lo < batch.num_rows:
                yield from out()
    if held:
        yield from out()


# --- 3. keys of a slice ---------------------------------------------------------------------------------


def radix_order(columns: np.ndarray) -> np.ndarray:
    """The order of rows of unsigned 32-bit columns, the first the most significant: a radix sort by 16 bits at a
    time from the least significant on (numpy sorts 16-bit numbers stably by radix). Digits that are zero
    everywhere are left out."""
    order = None
    for column in columns[::-1]:
        for digit in (column & 0xFFFF, column >> 16):
            digit = digit.astype(np.uint16)
            if digit.any():
                order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(columns.shape[1]) if order is None else order


def run_lengths(columns: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different rows in order, and how often (or the sum of ``n``) each occurs."""
    if not columns.shape[1]:
        return columns, np.zeros(0, np.int64)
    order = radix_order(columns)
    columns = columns[:, order]
    new = np.ones(columns.shape[1], bool)
    new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, columns.shape[1])) if n is None else np.add.reduceat(n[order], first)
    return columns[:, first], count.astype(np.int64)


def ngrams(ids: np.ndarray, words: int = WORDS, step: int = 1) -> np.ndarray:
    """All runs of 2 to ``words`` ids without a zero, as columns filled up with zeros; every ``step``-th start."""
    parts = []
    for k in range(2, words + 1):
        if len(ids) >= k:
            ok = ids[: len(ids) - k + 1] > 0
            for i in range(1, k):
                ok = ok & (ids[i : len(ids) - k + 1 + i] > 0)
            start = np.flatnonzero(ok)[::step]
            part = np.zeros((words, len(start)), np.uint32)
            for i in range(k):
                part[i] = ids[start + i]
            parts.append(part)
    return np.concatenate(parts, axis=1) if parts else np.zeros((words, 0), np.uint32)


def as_keys(columns: np.ndarray) -> np.ndarray:
    """Fixed-width binary keys, whose order is that of their bytes."""
    return np.ascontiguousarray(columns.T.astype(">u4")).view(f"S{KEY}").ravel()


def with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(slice, ids) of rows (slice, size, codes, code, id) sorted by slice, those of words before that of codes."""
    code, number = [], []
    for batch in batches:
        size = batch.column(1).to_pylist()
        full = [i for i, x in enumerate(size) if x is not None]
        lo = 0
        for i in [*full, batch.num_rows]:
            code.append(batch.column(3).slice(lo, i - lo).to_numpy(zero_copy_only=False).astype(np.int64))
            number.append(batch.column(4).slice(lo, i - lo).to_numpy(zero_copy_only=False).astype(np.uint32))
            lo = i + 1
            if i < batch.num_rows:
                own = unpack(batch.column(2)[i].as_py(), 4 * size[i], np.int32)
                c, v = np.concatenate(code), np.concatenate(number)
                table = np.zeros(max(int(own.max(initial=0)), int(c.max(initial=0))) + 1, np.uint32)
                table[c] = v
                yield batch.column(0)[i].as_py(), table[own]
                code, number = [], []


def sampled_keys(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids in with_ids(batches):
            columns, _ = run_lengths(ngrams(ids, step=step))
            keys = as_keys(columns[:, :: max(1, columns.shape[1] // 4000)])
            yield pa.RecordBatch.from_arrays([pa.array([k.ljust(KEY, b"\0") for k in keys.tolist()], pa.binary())], ["key"])

    return tidied(run)


def range_rows(limits: np.ndarray):
    """For ``mapInArrow``: the counted keys of each slice, cut at the limits: (range, size, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids in with_ids(batches):
            columns, n = run_lengths(ngrams(ids))
            ends = [0, *np.searchsorted(as_keys(columns), limits), len(n)]
            out = [(r, lo, hi) for r, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if lo < hi]
            for at in range(0, len(out), 64):
                some = out[at : at + 64]
                payload = [pack(np.concatenate([columns[:, lo:hi].ravel(), n[lo:hi].astype(np.uint32)])) for _, lo, hi in some]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in some], pa.int32()), pa.array([hi - lo for _, lo, hi in some], pa.int32()), pa.array(payload, pa.binary())], ["range", "size", "payload"])

    return tidied(run)


# --- 4. ranges -------------------------------------------------------------------------------------------


def counted(least: int, most: int = 4_000_000):
    """For ``mapInArrow`` over rows (range, size, payload) sorted by range: its keys that occur ``least`` times.
    Keys that wait are counted together whenever there are ``most``, so that copies take no memory."""
    names = [*(f"w{i}" for i in range(WORDS)), "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n, size, limit = None, [], [], 0, most

        def merge() -> None:
            nonlocal held, n, size, limit
            columns, count = run_lengths(np.concatenate(held, axis=1), np.concatenate(n))
            held, n, size = [columns], [count], len(count)
            limit = max(most, 2 * size)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, n, size, limit
            if held:
                merge()
                columns, count = held[0], n[0]
                often = count >= least
                yield pa.RecordBatch.from_arrays([*(pa.array(c[often].astype(np.int64)) for c in columns), pa.array(count[often])], names)
            held, n, size, limit = [], [], 0, most

        for batch in batches:
            for r, k, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if r != at:
                    yield from out()
                    at = r
                a = unpack(payload, 4 * (WORDS + 1) * k, np.uint32).reshape(WORDS + 1, k)
                held.append(a[:WORDS])
                n.append(a[WORDS].astype(np.int64))
                size += k
                if size > limit:
                    merge()
        yield from out()

    return tidied(run)


# --- the counts ------------------------------------------------------------------------------------------


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The languages' words, (lang, n); the frequent words, (id, lang, word, f); the frequent phrases of 2 to
    WORDS words, (w0, w1, ..., f) by ids, 0 after the last word."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))
    slices = save(texts.mapInArrow(tidied(slice_rows), SLICES))
    words = save(slices.where("word is not null").groupBy("lang", "word").agg(F.sum("n").alias("f")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = numbered(words.where(F.col("f") >= least), "lang", "word", name="id").withColumn("id", F.col("id") + 1)
    often = save(often)
    if often.count() >= 1 << 32:
        raise ValueError("over 2**32 frequent words: keys of 32 bits a word don't hold them")
    ids = slices.where("word is not null").select("slice", "code", "lang", "word").join(often.select("lang", "word", "id"), ["lang", "word"])
    ids = save(ids.select("slice", "code", "id"))
    whole = slices.where("codes is not null").select("slice", "size", "codes")
    one = whole.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = lambda t: F.lit(None).cast(t)

    def dealt(codes: DataFrame, ids: DataFrame) -> DataFrame:
        both = codes.select("slice", "size", "codes", none("int").alias("code"), none("long").alias("id"))
        both = both.union(ids.select("slice", none("int"), none("binary"), "code", "id"))
        return both.repartition(max(1, min(2 * one["n"], 20_000)), "slice").sortWithinPartitions("slice", F.col("codes").isNotNull())

    ranges = max(slots, -(-(one["size"] or 0) * (WORDS - 1) * (KEY + 4) // RANGE))
    some = whole.select("slice").orderBy(F.xxhash64("slice"), "slice").limit(SAMPLED)
    got = dealt(whole.join(F.broadcast(some), "slice"), ids.join(F.broadcast(some), "slice")).mapInArrow(sampled_keys(16), "key binary").orderBy("key")
    sample = [bytes(r["key"]) for r in got.collect()]
    limits = np.unique(np.array([sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else [], f"S{KEY}"))
    keys = dealt(whole, ids).mapInArrow(range_rows(limits), "range int, size int, payload binary")
    keys = keys.repartition(2 * (len(limits) + 1), "range").sortWithinPartitions("range")
    phrases = save(keys.mapInArrow(counted(least), ", ".join(f"w{i} long" for i in range(WORDS)) + ", f long"))
    return totals, often, phrases


def _shifted(first: int, k: int) -> list:
    """The ``k`` ids from place ``first`` on as a key of WORDS ids."""
    return [F.col(f"w{first + i}") if i < k else F.lit(0).cast("long") for i in range(WORDS)]


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = COUNT, inside: int = INSIDE, scale: int = SCALE, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases.

    A-Z are lower-cased; words are what blanks part within pieces. A phrase of a occurrences cut after its
    first words, with l and r occurrences of the parts, scores floor(scale * a / (l + r)); its lowest cut
    counts, ties to the earliest. Phrases inside a longer candidate with ``inside`` percent of a or more
    are dropped. Order: score and a falling, then the phrase by UTF-8 bytes.

    Null texts are empty, a null language is ``und``; rows that repeat count again; no phrases give no rows;
    other columns of ``docs`` aren't read. A word of any length is one key.
    """
    totals, often, found = counts(docs, text_col, lang_col, least)
    place = [f"w{i}" for i in range(WORDS)]
    length = sum(((F.col(w) > 0).cast("int") for w in place), F.lit(0))
    found = found.withColumn("k", length)
    alone = often.select(F.col("id").alias("w0"), *(F.lit(0).cast("long").alias(w) for w in place[1:]), "f")
    every = found.select(*place, "f").union(alone)

    # Cuts after the first 1, 2, ... words, with the counts of both parts.
    cuts = None
    for size in range(2, WORDS + 1):
        for cut in range(1, size):
            part = found.where(F.col("k") == size).select(*place, F.col("f").alias("a"), F.lit(cut).alias("cut"), *(c.alias(f"l{i}") for i, c in enumerate(_shifted(0, cut))), *(c.alias(f"r{i}") for i, c in enumerate(_shifted(cut, size - cut))))
            cuts = part if cuts is None else cuts.union(part)
    left = every.select(*(F.col(w).alias(f"l{i}") for i, w in enumerate(place)), F.col("f").alias("l"))
    right = every.select(*(F.col(w).alias(f"r{i}") for i, w in enumerate(place)), F.col("f").alias("r"))
    cuts = cuts.join(left, [f"l{i}" for i in range(WORDS)]).join(right, [f"r{i}" for i in range(WORDS)])
    score = F.expr(f"cast((cast(a as decimal(20,0)) * {scale}) div (cast(l as decimal(20,0)) + r) as long)")
    lowest = cuts.withColumn("score", score).groupBy(*place).agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("s")).select(*place, "s.a", "s.l", "s.r", "s.score")

    # The most frequent longer candidate that holds a phrase.
    longer = None
    for size in range(3, WORDS + 1):
        for k in range(2, size):
            for first in range(size - k + 1):
                part = found.where(F.col("k") == size).select(*(c.alias(w) for w, c in zip(place, _shifted(first, k), strict=True)), "f")
                longer = part if longer is None else longer.union(part)
    longer = longer.groupBy(*place).agg(F.max("f").alias("longer"))
    kept = lowest.join(longer, place, "left").where(f"longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {inside}").drop("longer")

    word = often.select("id", "lang", F.col("word"))
    kept = kept.join(word.select(F.col("id").alias("w0"), "lang", F.col("word").alias("t0")), "w0")
    for i in range(1, WORDS):
        kept = kept.join(word.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"t{i}")), f"w{i}", "left")
    kept = kept.withColumn("phrase", F.concat_ws(" ", *(f"t{i}" for i in range(WORDS))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    kept = kept.withColumn("rank", rank).where(F.col("rank") <= best)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
