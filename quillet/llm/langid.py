"""Language identification with word-first backoff.

A known word adds its log frequency in each language; an unseen word falls back to its longest
character n-grams that are known, and to shorter ones where none is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fold, save, small_batches, tidied

#: Documents that the model is fitted on: of each language about PER_LANG, of all together about DOCUMENTS, in equal
#: shares for the languages; letters of one. That is the bound of what the model holds. The longest n-gram.
PER_LANG, DOCUMENTS, LARGEST, GRAM = 1500, 12_000, 100_000, 5
#: How much an unseen word counts against a known one.
BACKOFF = 0.5
STORE = 300_000
#: Times that an n-gram is met at least; an unseen run of letters is judged in slices of SLICE letters, and
#: counts as a word for every LETTERS letters; longer runs than LONGEST are no entries of the word table.
LEAST, SLICE, LETTERS, LONGEST = 3, 32, 10, 64
#: Cells of a table of all languages that is kept laid out; beyond, strings keep their own languages alone.
CELLS = 10_000_000
WORD = re.compile(r"[^\W\d_]+")


class Table(dict):
    """Log frequencies of strings in each language: the string's row, what all strings have, and what each has above
    it in the languages that it was met in."""

    def __init__(self, names: pa.Array, lang: np.ndarray, count: np.ndarray, n: int, least: int):
        """A row for each string and language, in any order; strings met ``least`` times in all are kept."""
        order = pc.sort_indices(pa.table({"s": names, "l": pa.array(lang)}), [("s", "ascending"), ("l", "ascending")]).to_numpy()
        names, lang, count = names.take(pa.array(order)), lang[order], count[order].astype(np.float64)
        total = np.bincount(lang, weights=count, minlength=n)
        self.base = np.log(0.5 / (total + 1))
        code = names.dictionary_encode()
        size = np.bincount(code.indices.to_numpy(), minlength=len(code.dictionary))
        keep = np.bincount(code.indices.to_numpy(), weights=count, minlength=len(code.dictionary)) >= least
        some = np.repeat(keep, size)
        self.lang = lang[some].astype(np.int32)
        self.above = (np.log(count[some] + 0.5) - np.log(0.5)).astype(np.float32)
        self.start = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int64)
        super().__init__((s, i) for i, s in enumerate(code.dictionary.filter(pa.array(keep)).to_pylist()))
        self.spread()

    def __reduce__(self):
        return _table, (dict(self), {k: v for k, v in self.__dict__.items() if k != "rows"})

    def spread(self) -> None:
        """Lays out what strings have above the base as rows of all languages, where that is not too large."""
        self.rows = None
        if len(self) * len(self.base) <= CELLS:
            self.rows = np.zeros((len(self), len(self.base)), np.float32)
            self.rows[np.repeat(np.arange(len(self)), np.diff(self.start)), self.lang] = self.above

    def mean(self, rows: list[int]) -> np.ndarray:
        """The mean log frequencies of some strings."""
        if self.rows is not None:
            return self.base + (self.rows[rows[0]] if len(rows) == 1 else self.rows[rows].mean(axis=0))
        out = np.zeros(len(self.base))
        for row in rows:  # a language stands once in a string's part
            of = slice(self.start[row], self.start[row + 1])
            out[self.lang[of]] += self.above[of]
        return self.base + out / len(rows)


def _table(rows: dict, more: dict) -> Table:
    t = Table.__new__(Table)
    t.update(rows)
    t.__dict__.update(more)
    t.spread()
    return t


def _counted(rows: list[tuple[str, str, int]], langs: list[str], n: int, least: int) -> Table:
    """A table of (lang, string, count), in which a pair may repeat."""
    total: Counter = Counter()
    for lang, s, c in rows:
        total[s, lang] += c
    at = {lang: i for i, lang in enumerate(langs)}
    return Table(pa.array([s for s, _ in total], pa.string()), np.array([at[x] for _, x in total], np.int64), np.array(list(total.values()), np.int64), n, least)


class Model:
    def __init__(self, counts: list[tuple[str, str, int]], grams: dict[int, list[tuple[str, str, int]]] | None = None):
        """counts: (lang, word, count) of the sample; grams: (lang, n-gram, count) by order, by default
        those of the words."""
        self.langs = sorted({lang for part in (counts, *(grams or {}).values()) for lang, _, _ in part})
        n = max(1, len(self.langs))
        self.words = _counted(counts, self.langs, n, 1)
        self.grams = [_counted([], self.langs, n, 1)]
        for k in range(1, GRAM + 1):
            own = [(lang, g, c) for lang, w, c in counts for g in grams_of(w, k)] if grams is None else grams.get(k, [])
            self.grams.append(_counted(own, self.langs, n, LEAST))

    @classmethod
    def of(cls, table: pa.Table) -> Model:
        """Of (k, lang, s, n): words with k = 0, n-grams by their order."""
        self = cls([])
        code = table["lang"].combine_chunks().dictionary_encode()
        code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
        names = code.dictionary.to_pylist()
        self.langs = sorted(names)
        rank = np.array([self.langs.index(x) for x in names], np.int64)
        lang = rank[code.indices.to_numpy()] if names else np.zeros(0, np.int64)
        order, count = table["k"].to_numpy(), table["n"].to_numpy()
        tables = []
        for k in range(GRAM + 1):
            own = np.flatnonzero(order == k)
            s = table["s"].take(pa.array(own))
            s = pa.concat_arrays(s.chunks) if s.num_chunks else pa.array([], pa.string())
            tables.append(Table(s, lang[own], count[own], max(1, len(names)), LEAST if k else 1))
        self.words, self.grams = tables[0], [self.grams[0], *tables[1:]]
        return self

    def vector(self, word: str) -> np.ndarray:
        """What one token of ``word`` adds for each language."""
        i = self.words.get(word)
        if i is not None:
            return self.words.mean([i])
        total = np.zeros(len(self.langs))
        for at in range(0, len(word), SLICE):
            part = min(len(word) - at, SLICE)
            for k in range(GRAM, 0, -1):
                table = self.grams[k]
                known = [i for g in grams_of(word, k, at) if (i := table.get(g)) is not None]
                if known:
                    total += BACKOFF * max(part / LETTERS, part / len(word)) * table.mean(known)
                    break
        return total


def grams_of(word: str, k: int, at: int | None = None) -> list[str]:
    """The n-grams of ``word``, or those that begin in its slice from letter ``at`` on."""
    source = word if k == 1 else f"<{word}>"
    last = len(source) - k + 1
    if at is not None and at + SLICE < len(word):
        last = min(last, at + SLICE)
    return [source[i : i + k] for i in range(at or 0, last)]


def fit(docs: DataFrame, per_lang: int = PER_LANG, documents: int = DOCUMENTS) -> Model:
    """Fitted on a sample of rows with text and lang outside the held-out fold, chosen by a hash of the id: about
    ``per_lang`` of each language, or as many as give all languages an equal share of ``documents`` (one at least),
    texts of at most ``LARGEST`` letters where a language has more than one. All languages are learned, and all
    words and n-grams of the sample count."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    # One row a language, joined back: as many as there are languages, each with the least hash to be sure of one.
    hashed = rows.withColumn("quillet_h", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)))
    totals = save(hashed.groupBy("lang").agg(F.count("*").alias("quillet_n"), F.min("quillet_h").alias("quillet_least")))
    share = min(float(per_lang), documents / max(1, totals.count()))
    limit = F.greatest(F.col("quillet_least") + 1, (1_000_000 * F.least(F.lit(1.0), share / F.col("quillet_n"))).cast("long"))
    chosen = hashed.join(totals.select("lang", "quillet_least", limit.alias("quillet_limit")), "lang").where("quillet_h < quillet_limit").where((F.length("text") <= LARGEST) | (F.col("quillet_h") == F.col("quillet_least")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            """Words, and n-grams of all of them, in parts."""
            for k in range(GRAM + 1):
                found: Counter = Counter()
                for (lang, w), c in seen.items():
                    if k:
                        for g in grams_of(w, k):
                            found[lang, g] += c
                    elif len(w) <= LONGEST:
                        found[lang, w] += c
                items = list(found.items())
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x, _ in items], pa.string()), pa.array([k] * len(items), pa.int32()), pa.array([x[1] for x, _ in items], pa.string()), pa.array([c for _, c in items], pa.int64())], ["lang", "k", "s", "n"])
            seen.clear()

        letters = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.update((lang, w) for w in WORD.findall(text.as_py().lower()))
                letters += len(text.as_py())
                if letters > 20_000_000:
                    yield from out()
                    letters = 0
        yield from out()

    got = chosen.select("lang", "text").mapInArrow(count, "lang string, k int, s string, n long")
    # Parts are summed up in the tasks; one shuffle serves the sums of languages and those of all.
    by = got.repartition("k", "s").groupBy("k", "s", "lang").agg(F.sum("n").alias("n"))
    every = by.withColumn("t", F.sum("n").over(Window.partitionBy("k", "s"))).where((F.col("k") == 0) | (F.col("t") >= LEAST))
    return Model.of(every.select("k", "lang", "s", "n").toArrow())  # of a bounded sample


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.clear()

    def clear(self):
        self.letters, self.row = 0, {}
        self.vectors = np.zeros((1024, max(1, len(self.m.langs))))

    def add(self, word: str) -> None:
        if len(self.row) == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[len(self.row)] = self.m.vector(word)
        self.row[word] = len(self.row)
        self.letters += len(word)

    def __call__(self, text: str) -> tuple[str, float]:
        if not self.m.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        words = WORD.findall(text.lower())
        if len(self.row) > STORE or self.letters > 30 * STORE:
            self.clear()
        for w in set(words).difference(self.row):
            self.add(w)
        s = self.vectors[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0)
        p = np.exp(s - s.max())
        i = int(np.argmax(s))
        return self.m.langs[i], float(p[i] / p.sum())


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; whole texts.

    ``und`` with score 0 where text is null or has no letter; ties go to the smaller language name.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # words and n-grams of DOCUMENTS documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got = [scorer(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(F.col(id_col), 4) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("t"))
    return small_batches(rows).mapInArrow(tidied(run), "doc_id long, held_out boolean, lang_pred string, score double")
