"""Spelling variants: pairless wildcard groups.

Each word of the vocabulary is written once a position with that letter as a wildcard, and once a position
without it. Words of one wildcard group (position, prefix, suffix) differ by a replacement; a deletion that
equals a shorter word is an insertion of that word. Of a group only its size and its two best words are kept:
the best near word of a member is the first, or the second for the first itself. No pair of words is made.

Words go by their place in the order of falling count and rising code points, so that the best of a group is
its smallest number. A wildcard group has a word for each letter of the alphabet at most, and a group of
deletions that many for each position.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import numbered, save, tidied

#: Letters of a run, words of so many code points, met so often; a form has so many times a word's count.
LETTERS, LENGTH, COUNT, TIMES = "[A-Za-z\\u00C0-\\u00FF]", 7, 2, 10
#: One occurrence in so many loses a letter, by its hash.
TYPOS = 31
#: Words from so many code points on are met by digests of what stands before and after a position: their keys
#: have a fixed width, so that a word of n letters has n keys, not n * n letters.
LONG = 40
#: Roles of a key: a wildcard, a deletion of a longer word, the word itself.
WILD, LONGER, SELF = 0, 1, 2


def occurrences(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """(word) for each run of letters that may give a word of ``length``: A-Z lower-cased, one in TYPOS by the
    crc32 of ``<id>:<run>`` without a letter. Null texts have none; a null id is written as nothing."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("quillet_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"({LETTERS}{{{length},}})"), F.lit(1))).alias("run"))
    runs = runs.select("quillet_id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "quillet_id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % TYPOS == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= length)


def vocabulary(words: DataFrame, count: int = COUNT) -> DataFrame:
    """(no, word, n): words met ``count`` times at least, numbered by falling n and rising code points."""
    return numbered(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count), F.desc("n"), "word")


def keys(word: str) -> Iterator[tuple[bytes, int]]:
    """The keys of a word with their roles, a key once. The key's first byte tells the forms apart. Two words
    share a key of the same first byte if and only if they differ as told, and then just one."""
    n = len(word)
    letters = [c.encode() for c in word]
    if n >= LONG:
        before, after = digests(letters), digests(letters[::-1])[::-1]  # of what stands before i, and from i on
    # Equal neighbours give the same deletion: the first of them stands for all.
    first = [i for i in range(n) if not i or word[i] != word[i - 1]]
    if n < LONG:
        for i in range(n):
            yield b"w" + b"".join(letters[:i]) + b"*" + b"".join(letters[i + 1 :]), WILD
        whole = word.encode()
        yield b"d" + whole, SELF
    else:
        for i in range(n):
            yield b"W" + i.to_bytes(8, "big") + before[i] + after[i + 1], WILD
        for i in range(n + 1):
            yield b"D" + i.to_bytes(8, "big") + before[i] + after[i], SELF
    if n - 1 < LONG:
        for i in first:
            yield b"d" + b"".join(letters[:i] + letters[i + 1 :]), LONGER
    else:
        for i in first:
            yield b"D" + i.to_bytes(8, "big") + before[i] + after[i + 1], LONGER


def digests(letters: list[bytes]) -> list[bytes]:
    """128-bit digests of the first 0, 1, 2, ... letters."""
    h, out = hashlib.blake2b(digest_size=16), []
    for c in letters:
        out.append(h.copy().digest())
        h.update(c)
    return [*out, h.digest()]


def key_rows(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    names = ["key", "no", "role"]
    key, no, role = [], [], []
    for batch in batches:
        for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for k, r in keys(word):
                key.append(k)
                no.append(number)
                role.append(r)
                if len(key) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(no, pa.int64()), pa.array(role, pa.int32())], names)
                    key, no, role = [], [], []
    if key:
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(no, pa.int64()), pa.array(role, pa.int32())], names)


def near(vocab: DataFrame) -> DataFrame:
    """(no, n_near, best): how many words of ``vocab(no, word)`` differ by one inserted, deleted or replaced
    code point, and the smallest number among them. Words without near words don't appear."""
    rows = vocab.select("no", "word").mapInArrow(tidied(key_rows), "key binary, no long, role int")
    group = Window.partitionBy("key").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_longer = F.col("role") == LONGER
    met = rows.select(
        "no",
        "role",
        F.count("*").over(group).alias("size"),
        F.first("no").over(group).alias("first"),
        F.nth_value("no", 2).over(group).alias("second"),
        F.count(F.when(is_longer, 1)).over(group).alias("longer"),
        F.min(F.when(is_longer, F.col("no"))).over(group).alias("best_longer"),
        F.min(F.when(F.col("role") == SELF, F.col("no"))).over(group).alias("shorter"),
    ).where("size > 1")
    n = F.when(F.col("role") == WILD, F.col("size") - 1).when(is_longer, F.when(F.col("shorter").isNotNull(), 1).otherwise(0)).otherwise(F.col("longer"))
    best = F.when(F.col("role") == WILD, F.when(F.col("no") == F.col("first"), F.col("second")).otherwise(F.col("first"))).when(is_longer, F.col("shorter")).otherwise(F.col("best_longer"))
    return met.select("no", n.alias("k"), best.alias("best")).where("k > 0").groupBy("no").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame, longest: int) -> DataFrame:
    """(no, root) of ``links(no, form)``: where the forms lead, for chains of ``longest`` links at most. Each
    round halves what is left of every chain."""
    at = links.select("no", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        at = save(at)
        on = at.select(F.col("no").alias("root"), F.col("root").alias("further"))
        at = at.join(on, "root", "left").select("no", F.coalesce("further", "root").alias("root"))
    return at


def variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, count: int = COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts.

    A word's form is its near word of the largest count (ties: the smallest in code points), if that count is
    ``times`` the word's own or more; root follows the forms to the last. Null and empty texts have no words,
    rows that repeat count again, other columns of ``docs`` aren't read; no words give no rows. ``times`` is 2
    or more, so that counts rise along forms and no chain returns to a word.
    """
    vocab = vocabulary(occurrences(docs, text_col, id_col, length), count)
    top = vocab.agg(F.max("n")).first()[0] or 1
    found = vocab.join(near(vocab), "no", "left")
    other = vocab.select(F.col("no").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    found = save(found.join(other, "best", "left"))
    is_form = F.col("best_n") >= F.col("n") * times
    links = found.where(is_form).select("no", F.col("best").alias("form"))
    end = roots(links, max(1, math.floor(math.log(max(top, 1) / count + 1, times)) + 1))
    root = vocab.select(F.col("no").alias("root"), F.col("word").alias("root_word"))
    out = found.join(end, "no", "left").join(root, "root", "left")
    return out.select(
        "word",
        F.when(is_form, F.col("best_word")).alias("form"),
        F.coalesce("root_word", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
