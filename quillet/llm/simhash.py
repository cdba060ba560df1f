"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated bits are grouped into partitions; a dynamic program gives each partition its own
threshold from estimated candidate counts, with sum(threshold + 1) = tau + 1, so that any two
fingerprints within tau differ by at most the threshold in some partition. Fingerprints are dealt
into buckets by partition value (a threshold t by balls of radius floor(t/2) and ceil(t/2)), and
every bucket is verified in place; only a spanning forest of the verified links leaves a task.
With wide fingerprints these links are candidates: what counts is the exact Jaccard similarity of the
shingle sets. Groups with a link that fails it are compared in place for links between their parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, local_components, release, save, small_batches, tidied

BITS = 64
#: Fingerprints compared as one block; larger buckets are split into pairs of blocks.
BLOCK = 16384
#: Cost of one dealt row against one comparison, as measured; it steers the plan, not the result.
ROW_COST = 600.0
SAMPLE, SIZING = 2000, 16
#: Nodes whose texts are looked up by a broadcast of 16 bytes each; more of them are met by a shuffle.
LOOKED_UP = 1_000_000
#: Pairs that a task holds at once; rows of a group that are compared as one block.
PAIRS, GROUP_BLOCK = 500_000, 2048


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles of ASCII-lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, 42)], np.uint64)
    space = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(space + 1).tolist()]
    ends = space.tolist()[k - 1 :]
    ends.append(len(joined))
    return np.array([h(joined[s:e], 42) for s, e in zip(starts, ends)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none: zero."""
    n = len(hashes)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            counts += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        if whole < len(bits):
            counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


#: Odd multipliers that derive further hash words from the first (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _remix(h: np.ndarray, m: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(m)
    return (h ^ (h >> np.uint64(29))) * np.uint64(m ^ 0xD6E8FEB86659FD92 | 1)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, wide: bool = False) -> DataFrame:
    """(doc_id, fp long[, w1, w2, w3, node, at long]) for every row; null text counts as empty (fp 0).

    ``node`` is a hash of the shingle set, ``at`` one of the text. Fewer words than ``shingle``: the
    whole sequence is one shingle. Ids may be null or repeat.
    """
    names = ["fp", "w1", "w2", "w3", "node"] if wide else ["fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            out = np.zeros((batch.num_rows, len(names)), np.uint64)
            for i, text in enumerate(batch.column(1)):
                h = shingle_hashes(text.as_py() or b"", shingle)
                if len(h):
                    out[i, 0] = majority(h)
                    for j, m in enumerate(MIX if wide else ()):
                        out[i, j + 1] = majority(_remix(h, m))
                if wide:
                    out[i, 4] = xxhash.xxh64_intdigest(np.unique(h).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(out[:, j]).view(np.int64)) for j in range(len(names))), *batch.columns[2:]], ["doc_id", *names, *more])

    more = ["at"] if wide else []
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    if wide:
        rows = rows.withColumn("at", F.xxhash64("t"))
    return small_batches(rows).mapInArrow(tidied(run), "doc_id long, " + ", ".join(f"{n} long" for n in names + more))


def ball(width: int, radius: int) -> np.ndarray:
    """XOR masks of at most ``radius`` of ``width`` bits, the empty mask first."""
    return np.array([sum(1 << b for b in c) for r in range(min(radius, width) + 1) for c in combinations(range(width), r)], np.int64)


def project(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return out


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits that go together, by greedily joining the bit most correlated with a partition's own."""
    x = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    x -= x.mean(axis=0)
    x /= np.maximum(x.std(axis=0), 1e-9)
    corr = np.abs(x.T @ x) / max(1, len(x))
    free, out = list(range(BITS)), []
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        own = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (corr[b, own].sum(), -b)))
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def plan(sample: np.ndarray, n: int, tau: int) -> list[tuple[list[int], int]]:
    """The cheapest (bits, threshold) list for ``n`` fingerprints, estimated on a bounded sample.

    Partitions whose threshold is -1 are left out. Every plan finds all pairs within ``tau``.
    """
    s = np.unique(sample)[:SAMPLE]
    best: tuple[float, list] = (np.inf, [])
    for parts in range(2, min(tau + 1, 10) + 1):
        if not len(s):
            break
        groups = group_bits(s, parts)
        costs = []
        for bits in groups:
            v = project(s, bits)
            d = np.bincount(np.bitwise_count(v[:, None] ^ v[None, :]).ravel(), minlength=BITS + 1).astype(float)
            d[0] -= len(v)
            w, row = len(bits), [0.0]
            pairs = max(1.0, d.sum())
            for t in range(tau + 1):
                up, down = (t + 1) // 2, t // 2
                entries = sum(comb(w, r) for r in range(up + 1))
                uniform = sum(comb(w, r) for r in range(t + 1)) / 2.0**w
                seen = (d[: t + 1].sum() + uniform) / (pairs + 1)
                widen = entries * sum(comb(w, r) for r in range(down + 1)) / sum(comb(w, r) for r in range(t + 1))
                row.append(np.inf if w > 38 or entries > 3000 else ROW_COST * entries * n + n * n / 2 * min(1.0, max(seen, uniform) * widen))
            costs.append(row)
        # best[p][u]: cheapest way to give the first p partitions u units (units = threshold + 1)
        table = [[np.inf] * (tau + 2) for _ in range(parts + 1)]
        choice = [[0] * (tau + 2) for _ in range(parts + 1)]
        table[0][0] = 0.0
        for p in range(parts):
            for have in range(tau + 2):
                for units in range(tau + 2 - have):
                    c = table[p][have] + costs[p][units]
                    if c < table[p + 1][have + units]:
                        table[p + 1][have + units], choice[p + 1][have + units] = c, units
        if table[parts][tau + 1] < best[0]:
            chosen, u = [], tau + 1
            for p in range(parts, 0, -1):
                if choice[p][u]:
                    chosen.append((groups[p - 1], choice[p][u] - 1))
                u -= choice[p][u]
            best = (table[parts][tau + 1], chosen)
    return best[1] or [(list(range(i * BITS // (tau + 1), (i + 1) * BITS // (tau + 1))), 0) for i in range(tau + 1)]


def _verified(words: np.ndarray, i: np.ndarray, j: np.ndarray, tau: int, wide: int | None) -> np.ndarray:
    d = np.bitwise_count(words[0][i] ^ words[0][j])
    ok = d <= tau
    if wide is not None and ok.any():
        at = np.flatnonzero(ok)
        total = d[at].astype(np.int64)
        for w in words[1:]:
            total += np.bitwise_count(w[i[at]] ^ w[j[at]])
        ok[at[total > wide]] = False
    return ok


def _spanning(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Positions of a spanning forest of the links a-b, nearest first."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = inv[: len(a)], inv[len(a) :]
    order = np.argsort(d, kind="stable")
    rank = np.empty(len(a), np.int64)
    rank[order] = np.arange(len(a))
    label, live, chosen = np.arange(len(nodes)), np.arange(len(a)), []
    while True:
        live = live[label[i[live]] != label[j[live]]]
        if not len(live):
            return np.concatenate(chosen) if chosen else live
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, label[i[live]], rank[live])
        np.minimum.at(best, label[j[live]], rank[live])
        own = order[np.unique(best[best < len(a)])]
        chosen.append(own)
        x, y = local_components(label[i[own]], label[j[own]])
        onto = np.arange(len(nodes))
        onto[x] = y
        label = onto[label]


def _distance(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words)


def _bucket_links(key: np.ndarray, side: np.ndarray, words: np.ndarray, tau: int, wide: int | None, part: np.ndarray | None = None):
    """Positions (i, j) of verified pairs in rows sorted by key; side 0: index, 1: probe only.
    With ``part``: all pairs of different parts.

    At most about PAIRS pairs are in memory. Of a large bucket, only links that join what is still
    apart are verified and given: fewer than its rows, however many of them are near copies.
    """
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    small = np.flatnonzero((size > 1) & (size <= 64))
    for own in np.split(small, np.flatnonzero(np.diff(np.cumsum(size[small] ** 2) // PAIRS)) + 1):
        s, n = start[own], size[own]
        rows = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        reps, first = np.repeat(n, n), np.repeat(s, n)
        index = side[rows] == 0
        rows, reps, first = rows[index], reps[index], first[index]
        if not len(rows):
            continue
        i = np.repeat(rows, reps)
        j = np.repeat(first, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        keep = (i < j) | (side[j] == 1)
        if part is not None:
            keep &= part[i] != part[j]
        i, j = i[keep], j[keep]
        ok = _verified(words, i, j, tau, wide)
        yield i[ok], j[ok]
    for s, n in zip(start[size > 64], size[size > 64]):
        fp, label = words[0][s : s + n], np.arange(n)
        index = np.flatnonzero(side[s : s + n] == 0)
        step = max(1, PAIRS // n)
        for at in range(0, len(index), step):
            own = index[at : at + step]
            near = np.bitwise_count(fp[own][:, None] ^ fp[None, :]) <= tau
            if part is not None:
                near &= part[s + own][:, None] != part[None, s : s + n]
                i, j = np.nonzero(near)
                i, j = s + own[i], s + j
                ok = _verified(words, i, j, tau, wide)
                yield i[ok], j[ok]
                continue
            if np.count_nonzero(near) > 4 * len(own):
                near &= label[own][:, None] != label[None, :]
            i, j = np.nonzero(near)
            i = own[i]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            ok = _verified(words, s + i, s + j, tau, wide)
            if ok.any():
                i, j = i[ok], j[ok]
                a, b = local_components(label[i], label[j])
                if wide is None:
                    yield s + a, s + b
                else:
                    own = _spanning(label[i], label[j], _distance(words, s + i, s + j))
                    yield s + i[own], s + j[own]
                onto = np.arange(n)
                onto[a] = b
                label = onto[label]


def links(unique: DataFrame, tau: int, wide: int | None = None, parts_only: bool = False) -> DataFrame:
    """A spanning forest (a, b) of the links between the rows of ``unique(fp)``, named by fp.

    ``wide``: the rows are (fp, w1, w2, w3, node), a pair must also differ in at most so many of all
    256 bits, and links name the node. ``parts_only``: rows have a ``part`` too, and all links between
    different parts are given.
    """
    names = (["fp", "w1", "w2", "w3", "node"] if wide is not None else ["fp"]) + ["part"] * parts_only
    n = unique.count()
    step = max(1, n // (4 * SAMPLE))
    sample = unique.where(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).select("fp").limit(4 * SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    chosen = plan(sample, n, tau)
    deals = [(p, bits, ball(len(bits), (t + 1) // 2), comb_sum(len(bits), t // 2)) for p, (bits, t) in enumerate(chosen)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                cols = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                fp = cols[0].view(np.uint64)
                for p, bits, masks, near in deals:
                    keys = (project(fp, bits)[:, None] ^ masks[None, :]) | (np.int64(p) << 40)
                    side = np.broadcast_to((np.arange(len(masks)) >= near).astype(np.int8), keys.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(side.ravel()), *(pa.array(np.repeat(c, len(masks))) for c in cols)], ["key", "side", *names])

    schema = ", ".join(f"{x} long" for x in names)
    dealt = unique.select(*names).mapInArrow(deal, f"key long, side byte, {schema}").withColumn("block", F.lit(0))
    # Bucket sizes are estimated from one row in SIZING; they decide how a bucket is split, no more.
    some = unique.select(*names).where(F.pmod(F.xxhash64("fp"), F.lit(SIZING)) == 0).mapInArrow(deal, f"key long, side byte, {schema}")
    sizes = some.groupBy("key").agg((F.count("*") * SIZING).alias("n")).where(F.col("n") > BLOCK)
    heavy = save(sizes)
    if heavy.limit(1).count():
        # A large bucket becomes pairs of blocks: a row of block x goes to (x, y) for every y.
        count = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("fp"), count).cast("int")
        pair = F.transform(F.sequence(F.lit(0), count - 1), lambda y: F.least(own, y) * count + F.greatest(own, y))
        dealt = dealt.drop("block").join(heavy, "key", "left").withColumn("block", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(pair))).select("key", "side", *names, "block")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[np.ndarray] = []
        found_a, found_b, found_d, pending = [], [], [], 0

        def shrink() -> int:
            """What is found becomes star edges, or a forest of wide links: fewer than the nodes it names."""
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            if parts_only:
                a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            elif wide is None:
                a, b = local_components(a, b)
            else:
                d = np.concatenate(found_d)
                own = _spanning(a, b, d)
                a, b, found_d[:] = a[own], b[own], [d[own]]
            found_a[:], found_b[:] = [a], [b]
            return len(a)

        def flush():
            shrink()
            found_d.clear()
            return pa.RecordBatch.from_arrays([pa.array(found_a.pop()), pa.array(found_b.pop())], ["a", "b"])

        def work(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal pending
            group = cols[0] * 1 if not cols[-1].any() else np.cumsum(np.r_[0, (cols[0][1:] != cols[0][:-1]) | (cols[-1][1:] != cols[-1][:-1])])
            words, node = [c.view(np.uint64) for c in cols[2 : 3 if wide is None else 6]], cols[2 if wide is None else 6]
            for i, j in _bucket_links(group, cols[1], words, tau, wide, cols[7] if parts_only else None):
                if len(i):
                    differ = node[i] != node[j]
                    i, j = i[differ], j[differ]
                    found_a.append(node[i])
                    found_b.append(node[j])
                    if wide is not None and not parts_only:
                        found_d.append(_distance(words, i, j))
                    pending += len(i)
                    if pending > PAIRS:
                        if shrink() > PAIRS // 2 and parts_only:
                            yield flush()
                        pending = 0

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            last = np.searchsorted(held[0], held[0][-1])  # the last key may go on in the next batch
            if last > 200_000 or (last and len(held[0]) > 400_000):
                yield from work([c[:last] for c in held])
                held = [c[last:].copy() for c in held]
                if sum(map(len, found_a)) > PAIRS:
                    yield flush()
                    pending = 0
        if held and len(held[0]):
            yield from work(held)
        if found_a:
            yield flush()

    parts = int(unique.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = sum(len(d[2]) for d in deals)
    parts = max(parts, -(-n * per // 2_000_000))
    ready = dealt.select("key", "side", *names, "block").repartition(parts, "key", "block").sortWithinPartitions("key", "block")
    return save(ready.mapInArrow(tidied(verify), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def comb_sum(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def shingle_sets(own: DataFrame, df: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, s): the shingle hashes of own(node, at), sorted as the signed numbers that they are kept as, at the hash of a text of each node."""
    texts = df.select(F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("t"), F.xxhash64(F.col(text_col).cast("binary")).alias("at"))
    few = own.limit(LOOKED_UP + 1).count() <= LOOKED_UP
    texts = texts.join(F.broadcast(own) if few else own, "at").groupBy("node").agg(F.first("t").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle).view(np.int64)) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return save(texts.mapInArrow(tidied(run), "node long, s array<long>"))


def similar(pairs: DataFrame, nodes: DataFrame, df: DataFrame, text_col: str, shingle: int, jaccard: float) -> DataFrame:
    """(a, b, ok) for ``pairs(a, b)``: whether the shingle sets of the nodes have this Jaccard similarity."""
    own = save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node"))
    sets = shingle_sets(own, df, text_col, shingle)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return save(both.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y")).alias("n")).select("a", "b", (F.col("i") >= F.lit(jaccard) * (F.col("n") - F.col("i")) - 1e-9).alias("ok")))


def links_in_groups(rows: DataFrame, tau: int, wide: int, jaccard: float) -> DataFrame:
    """Links (a, b) of at least this exact similarity between different parts of one group, enough to join all
    parts that have some. rows(whole, part, fp, w1, w2, w3, node, s).

    Groups are compared in pairs of blocks of GROUP_BLOCK rows, in place: candidates by their bits, of those
    still apart the shingle sets. Only star edges of what is found leave a task: fewer than its rows.
    """
    sizes = rows.groupBy("whole").count().select("whole", F.ceil(F.col("count") / GROUP_BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.least(own, y).alias("x"), F.greatest(own, y).alias("y")))
    dealt = rows.join(sizes, "whole").withColumn("own", own).withColumn("pair", F.explode(pairs))

    def compare(key, t):
        t = t.combine_chunks()
        cols = {c: t.column(c).to_numpy() for c in ("fp", "w1", "w2", "w3", "node", "part", "own")}
        words = [cols[c].view(np.uint64) for c in ("fp", "w1", "w2", "w3")]
        lists = t.column("s").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(pa.compute.list_value_length(lists).to_numpy())]
        size = np.diff(ends)
        label = np.unique(cols["part"], return_inverse=True)[1]
        across = key[1].as_py() != key[2].as_py()
        found_a, found_b = [], []
        for i in range(len(label) - 1):
            near = np.flatnonzero((np.bitwise_count(words[0][i] ^ words[0][i + 1 :]) <= tau) & (label[i + 1 :] != label[i])) + i + 1
            if across and len(near):
                near = near[cols["own"][near] != cols["own"][i]]
            if len(near):
                near = near[sum(np.bitwise_count(w[i] ^ w[near]).astype(np.int64) for w in words) <= wide]
            mine = flat[ends[i] : ends[i + 1]]
            for j in near.tolist():
                if label[j] == label[i]:
                    continue
                other = flat[ends[j] : ends[j + 1]]
                at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                both = int(np.count_nonzero(mine[at] == other)) if len(mine) else 0
                if both >= jaccard * (size[i] + size[j] - both) - 1e-9:
                    found_a.append(i)
                    found_b.append(j)
                    label[label == label[j]] = label[i]
        return pa.table({"a": cols["node"][found_a], "b": cols["node"][found_b]})

    names = ["whole", "part", "fp", "w1", "w2", "w3", "node", "s", "own"]
    found = dealt.select(*names, F.col("pair.x").alias("x"), F.col("pair.y").alias("y")).groupBy("whole", "x", "y").applyInArrow(compare, "a long, b long")
    return save(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def exact_links(unique: DataFrame, df: DataFrame, text_col: str, shingle: int, tau: int, wide: int, jaccard: float) -> DataFrame:
    """Links (a, b) of at least this exact similarity, enough to join all candidates that have it."""
    nodes = save(unique.groupBy("node").agg(F.min("at").alias("at")))
    met = similar(links(unique, tau, wide), nodes, df, text_col, shingle, jaccard)
    good, bad = met.where("ok").select("a", "b"), met.where(~F.col("ok")).select("a", "b")
    if not bad.limit(1).count():
        return good
    # A group all of whose candidate links hold is settled. The parts of the others may be linked by a
    # pair that no forest has named: they are compared within their group.
    def labels(edges: DataFrame, name: str) -> DataFrame:
        c = components(edges)
        return c.union(c.select("root", "root").distinct()).withColumnRenamed("root", name)

    whole = save(labels(met.select("a", "b"), "whole"))
    split = bad.join(whole.withColumnRenamed("node", "a"), "a").select("whole").distinct()
    part = save(whole.join(split, "whole", "left_semi").join(labels(good, "part"), "node", "left").select("node", "whole", F.coalesce("part", "node").alias("part")))
    sets = shingle_sets(save(part.select("node").join(nodes, "node")), df, text_col, shingle)
    more = links_in_groups(unique.drop("low", "at").join(part, "node").join(sets, "node"), tau, wide, jaccard)
    return good.union(more)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, tau: int = 16, wide: int | None = 54, jaccard: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id reachable.

    With ``wide`` the fingerprint has 256 bits, the first 64 of which are searched within ``tau``; the
    pairs found that differ in at most ``wide`` of all bits are linked if the Jaccard similarity of
    their shingle sets is ``jaccard`` or more. Texts of one shingle set are linked. Empty texts have
    fingerprint 0. Null ids are kept, never chosen as component_id while the group has another.
    """
    names = ["fp", "w1", "w2", "w3", "node"] if wide is not None else ["fp"]
    docs = save(fingerprints(df, id_col, text_col, shingle, wide is not None))
    if wide is None:
        unique = save(docs.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("node", F.col("fp")))
        docs = docs.withColumn("node", F.col("fp"))
        moved, lows = components(links(unique, tau)), unique
    else:
        unique = save(docs.groupBy(*names).agg(F.min("doc_id").alias("low"), F.min("at").alias("at")))
        moved, lows = components(exact_links(unique, df, text_col, shingle, tau, wide, jaccard)), unique.groupBy("node").agg(F.min("low").alias("low"))
    comp = save(moved.union(moved.select("root", "root").distinct()))
    roots = lows.join(comp, "node").groupBy("root").agg(F.min("low").alias("component_id"))
    moved = comp.join(roots, "root").select("node", "component_id")
    label = save(lows.join(moved, "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id")))
    return docs.join(label, "node").select("doc_id", "fp", "component_id")
