"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are all words that enough examples hold, of either class. A term's weight is TF-IDF times one plus
its chi-squared with the label in critical values: bare TF-IDF finds examples of the same language and topic,
whatever their label. Examples stand in an inverted index whose postings are cut into blocks with their
largest weights. A query visits blocks by falling upper bound and stops once no block can better its
k-th neighbour, so its neighbours are exact. Votes weighted by similarity are calibrated.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fold, small_batches, tidied
from ._learn import Logistic, labelled_texts
from .filters import keep_rows

#: Labelled rows of either class that serve as examples at most, and their longest text.
PER_CLASS, LONGEST = 3000, 100_000
#: Examples that hold a term at least.
MIN_DF = 3
BLOCK, NEIGHBOURS = 64, 15
#: Blocks visited before bounds are met with what was found; lists of one in HEAVY examples are matrix rows.
FIRST, HEAVY = 4, 12
#: Critical value of chi-squared (one degree of freedom, one in a thousand): what a term's counts for.
CRITICAL = 10.83
#: Similarity that stands for "no neighbour": weak neighbours move a score little.
PRIOR = 0.05
THRESHOLD = 0.7
WORD = re.compile(r"[^\W_]+")


class BlockMaxIndex:
    """Postings of sparse vectors by term, in blocks of BLOCK examples with block maxima.

    A slot is one term in one block: slots of term t are ``at[t]`` to ``at[t + 1]``, the postings of slot
    s ``start[s]`` to ``start[s + 1]``. Lists that hold over one in HEAVY examples are kept as rows of a
    matrix: they are summed for all examples at once, and what they sum to in a block bounds it exactly.
    """

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        self.n, self.blocks = n, -(-n // BLOCK)
        heavy = np.bincount(term, minlength=n_terms) * HEAVY > n
        self.row = np.where(heavy, np.cumsum(heavy) - 1, -1)
        self.rows = np.zeros((int(heavy.sum()), self.blocks * BLOCK))
        own = heavy[term]
        self.rows[self.row[term[own]], example[own]] = weight[own]
        example, term, weight = example[~own], term[~own], weight[~own]
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        term, block = term[order], self.example // BLOCK
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])][: len(term)])
        self.start = np.r_[first, len(term)]
        self.block = block[first]
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.at = np.searchsorted(term[first], np.arange(n_terms + 1))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights), the k examples of the largest product above zero, nearest
        first, ties to the smaller one; without example ``skip``."""
        out = []
        for lo in range(0, len(queries), 64):
            part = queries[lo : lo + 64]
            q = np.zeros((len(part), len(self.rows)))
            for i, (terms, weights) in enumerate(part):
                row = self.row[terms]
                q[i, row[row >= 0]] = weights[row >= 0]
            base = q @ self.rows
            for i, (terms, weights) in enumerate(part):
                light = self.row[terms] < 0
                out.append(self._one(base[i], terms[light], weights[light], k, skip[lo + i] if skip else -1))
        return out

    def _one(self, base: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks are visited by falling bound, first FIRST of them, then those that can still better
        the k-th found."""
        lo, hi = self.at[terms], self.at[terms + 1]
        slot, q = _ranges(lo, hi), np.repeat(weights, hi - lo)
        block = self.block[slot]
        bound = base.reshape(self.blocks, BLOCK).max(axis=1, initial=0) + np.bincount(block, weights=q * self.most[slot], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        ids, sims, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for now in (order[:FIRST], order[FIRST:]):
            chosen = np.zeros(self.blocks, bool)
            chosen[now] = True
            chosen &= (bound > 0) & (bound >= least * (1 - 1e-12))
            at = chosen[block]
            lo = slot[at]
            hi, lo = self.start[lo + 1], self.start[lo]
            entry = _ranges(lo, hi)
            part = np.bincount(self.example[entry], weights=np.repeat(q[at], hi - lo) * self.weight[entry], minlength=len(base))
            part = part + base
            hit = np.flatnonzero((part > 0) & (part >= least) & np.repeat(chosen, BLOCK))
            hit = hit[hit != skip]
            if len(hit) > 4 * k:
                hit = hit[part[hit] >= np.partition(part[hit], len(hit) - k)[len(hit) - k]]
            ids, sims = np.concatenate([ids, hit]), np.concatenate([sims, part[hit]])
            best = np.lexsort((ids, -sims))[:k]
            ids, sims = ids[best], sims[best]
            least = sims[-1] if len(ids) == k else 0.0
        return ids, sims


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    size = hi - lo
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + size, size)


def grouped(example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int, seed: int = 5) -> np.ndarray:
    """An order of the examples in which like ones stand together, so that block maxima bound closely:
    by their nearest of n / BLOCK centres, in a random projection."""
    if n <= 2 * BLOCK:
        return np.arange(n)
    rng = np.random.default_rng(seed)
    axes = rng.standard_normal((n_terms, 32)).astype(np.float32)
    x = np.zeros((n, 32))
    for d in range(32):
        x[:, d] = np.bincount(example, weights=weight * axes[term, d], minlength=n)
    centres = x[rng.choice(n, n // BLOCK, replace=False)]
    for _ in range(6):
        near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        size = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, weights=x[:, d], minlength=len(centres)) for d in range(32)], axis=1)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return np.lexsort((np.arange(n), near))


class Model:
    def __init__(self, texts: list[str], ids: list[int], y: np.ndarray, odds: float = 0.0):
        n = len(texts)
        # Texts are cut twice, so that no more than one's words are held at a time.
        df: Counter = Counter()
        for x in texts:
            df.update(set(WORD.findall(x.lower())))
        self.index = {t: i for i, t in enumerate(sorted(t for t, c in df.items() if c >= MIN_DF))}
        count = np.array([df[t] for t in self.index], float)
        del df
        bags = [self.terms(WORD.findall(x.lower())) for x in texts]
        held = np.zeros(len(count))
        for (terms, _), c in zip(bags, y):
            held[terms] += c
        share = min(max((y == 1).sum() / max(1, n), 1e-9), 1 - 1e-9)
        chi2 = (held - count * share) ** 2 / np.maximum(count * share * (1 - share) * np.maximum(1 - count / max(1, n), 1 / max(1, n)), 1e-12)
        self.weight = (np.log((n + 1) / (count + 1)) + 1) * (1 + chi2 / CRITICAL)
        vectors = [self.unit(*bag) for bag in bags]
        size = [len(t) for t, _ in vectors]
        term, weight = (np.concatenate([v[j] for v in vectors]) if n else np.zeros(0, kind) for j, kind in ((0, np.int64), (1, float)))
        order = grouped(np.repeat(np.arange(n), size), term, weight, n, len(count))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.y, self.example_ids = y[order], np.array(ids, np.int64)[order]
        self.search = BlockMaxIndex(np.repeat(place, size), term, weight, n, len(count))
        near = self.search.search(vectors[::3], NEIGHBOURS, place[::3].tolist())
        self.calibrated = Logistic(np.array([self.votes(*x) for x in near]).reshape(-1, 3), y[::3].astype(float), 0.1)
        self.calibrated.w[0] += odds

    def terms(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and how often they occur, by term."""
        at, n = np.unique(np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words)), return_counts=True)
        first = int(len(at) > 0 and at[0] < 0)
        return at[first:], n[first:]

    def unit(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of unit length, by term."""
        w = (1 + np.log(n)) * self.weight[terms]
        return terms, w / (np.sqrt(w @ w) or 1.0)

    def votes(self, ids: np.ndarray, sims: np.ndarray) -> list[float]:
        """Features of the nearest examples: weighted share of toxic votes, that times the similarity, and
        by how much a toxic one is nearer than any other."""
        if not len(ids):
            return [0.0, 0.0, 0.0]
        toxic = sims * self.y[ids]
        share = float(toxic.sum()) / (float(sims.sum()) + PRIOR)
        return [share, share * float(sims[0]), float(toxic.max() - (sims - toxic).max())]

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Score, ids of the nearest examples and their similarities for each text; equal texts are
        searched once."""
        once = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        near, each = [], iter(once)
        while part := [self.unit(*self.terms(WORD.findall((t or "").lower()))) for t in islice(each, 256)]:
            near += self.search.search(part, NEIGHBOURS)
        s = self.calibrated(np.array([self.votes(*x) for x in near]).reshape(-1, 3))
        at = [once[t] for t in texts]
        return s[at], [self.example_ids[near[i][0]] for i in at], [near[i][1] for i in at]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """On at most ``per_class`` labelled rows of either class outside the held-out fold."""
    s, odds = labelled_texts(docs, labels, "toxic", 3, 1, per_class, LONGEST)
    return Model(s["text"].tolist(), s["doc_id"].tolist(), s["y"].to_numpy(int), odds)


def keep(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` with all columns whose text isn't scored toxic; null text counts as empty.
    A score on the threshold counts as label 1, as in ``score``. Repeated rows are judged alike, columns of any name
    go along, an empty table stays empty."""
    return keep_rows(df, model, lambda m, texts: m.scores(texts)[0] < THRESHOLD, text_col)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", evidence: bool = True) -> DataFrame:
    """(doc_id, held_out, score, predicted[, evidence]) for every row.

    Null text counts as empty; a text without a known term has no neighbours and the score that goes
    with none. Repeated rows are scored alike. evidence: up to NEIGHBOURS (doc_id of the example,
    cosine), nearest first, ties by the example's place in the index.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most 2 * PER_CLASS examples of LONGEST letters
    kind = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s, ids, sims = m.scores(batch.column(2).to_pylist())
            cols = [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))]
            if evidence:
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *ids])), pa.array(np.concatenate([np.zeros(0), *sims]))], fields=list(kind))
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pairs))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "evidence"][: len(cols)])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(F.col(id_col), 3) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("t"))
    return small_batches(rows).mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int" + ", evidence array<struct<doc_id: long, cosine: double>>" * evidence)
