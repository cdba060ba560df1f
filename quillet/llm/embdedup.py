"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells.

Equal vectors of one label are one class, compared once and counted as often as it has members. Cells are
the nearest centroids. Two unit vectors of cosine >= c lie within sqrt(2 - 2c) of each other, so if their
cells differ, one of them lies within half of that from the plane between the two centroids; it is dealt
to the other's cell as a visitor. No link is lost to the cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, local_components, save
from .ann import as_matrix, dimension, sample_matrix, valid

#: Vectors that the centroids are fitted on at most, rows of the largest label that a cell holds about, cells
#: at most (beyond 8 million rows of one label cells grow), rounds.
SAMPLE, CELL, CELLS, ROUNDS = 20_000, 2000, 4096, 10
#: Vectors of a cell that are compared as one block; larger cells become pairs of blocks.
BLOCK = 4096


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centroids; an empty cell keeps its last centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        good = norm > 1e-12
        c[good] = total[good] / norm[good, None]
    return c


def assign(u: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The home cell of each row, and the other cells whose border is within ``reach``."""
    apart = np.maximum(np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0)), 1e-12)
    s = u @ c.T
    home = np.argmax(s, axis=1)
    near = (s[np.arange(len(u)), home][:, None] - s) / apart[home] <= reach
    near[np.arange(len(u)), home] = False
    return home, [np.flatnonzero(r) for r in near]


def near_duplicates(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows are compared if their labels are equal and not null (all rows without ``label_col``). Vectors that
    are null, zero, hold null or non-finite components, or are of another length than most, link with
    nothing. Rows of equal id, label and vector count once. An id with several vectors is one node, never
    linked with itself; what links with several of its vectors counts for each. Rows with null id are
    returned without links.
    """
    spark = df.sparkSession
    all_ids = df.select(F.col(id_col).cast("long").alias("vec_id"))
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    own = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("quillet_vector"), label.alias("label")).where("label is not null")
    # A class is named by a 128-bit digest of its vector, so that vectors are grouped once and not joined.
    rows = save(valid(own, "vec_id", "quillet_vector", "label", dim=dimension(df, vec_col)).withColumn("digest", F.md5("unit")))
    entries = rows.select("vec_id", "label", "digest").distinct()
    members = entries.groupBy("label", "digest").agg(F.min("vec_id").alias("low"), F.count("*").alias("times"))
    vectors = rows.groupBy("label", "unit").agg(F.min("digest").alias("digest"))
    classes = save(vectors.join(members, ["label", "digest"]).withColumn("node", F.monotonically_increasing_id()))
    size = classes.groupBy("label").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    sample = sample_matrix(classes.withColumnRenamed("low", "vec_id"), size["n"] or 0, SAMPLE)
    if not len(sample):
        return all_ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    centroids = spark.sparkContext.broadcast(spherical_kmeans(sample, int(np.clip(size["most"] // CELL, 1, CELLS))))  # at most CELLS vectors
    reach = np.sqrt(2 - 2 * cosine) / 2 + 1e-9

    def deal(batches):
        c = centroids.value
        for batch in batches:
            u = as_matrix(batch.column(1))
            if not len(u):
                continue
            home, visits = assign(u, c, reach)
            size = np.array([1 + len(v) for v in visits])
            pick = pa.array(np.repeat(np.arange(len(u)), size))
            cell = np.concatenate([np.r_[h, v] for h, v in zip(home, visits)])
            out = [batch.column(i).take(pick) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(cell.astype(np.int32)), pa.array(home.astype(np.int32)).take(pick), pa.array([v.astype(np.int32) for v in visits], pa.list_(pa.int32())).take(pick)], ["node", "unit", "label", "times", "cell", "home", "visits"])

    dealt = save(classes.select("node", "unit", "label", "times").mapInArrow(deal, "node long, unit binary, label string, times long, cell int, home int, visits array<int>"))
    sizes = dealt.groupBy("label", "cell").count().where(F.col("count") > BLOCK)
    heavy = sizes.select("label", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda y: F.struct(F.least(block, y).alias("x"), F.greatest(block, y).alias("y")))
    blocked = dealt.join(heavy, ["label", "cell"], "left").withColumn("own", block).withColumn("pair", F.explode(pairs))

    def compare(key, t):
        cell, x, y = key[1].as_py(), key[2].as_py(), key[3].as_py()
        t = t.combine_chunks()
        ids, home, own, times = (t.column(c).to_numpy() for c in ("node", "home", "own", "times"))
        u = as_matrix(t.column("unit"))
        visits = t.column("visits").to_pylist()
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        links = np.zeros(len(ids), np.int64)
        for lo in range(0, len(ids), 512):
            i = np.arange(lo, min(lo + 512, len(ids)))
            p, q = np.nonzero(u[i] @ u.T >= cosine)
            p = i[p]
            keep = (p < q) & ((home[p] == cell) | (home[q] == cell))
            if x != y:
                keep &= own[p] != own[q]
            p, q = p[keep], q[keep]
            # A pair across cells is met in both if each visits the other; it counts in the smaller.
            inner = home[p] == cell
            host, guest = np.where(inner, p, q), np.where(inner, q, p)
            twice = (home[p] != home[q]) & (home[guest] < cell)
            for m in np.flatnonzero(twice):
                twice[m] = home[guest[m]] in visits[host[m]]
            p, q = p[~twice], q[~twice]
            links += np.bincount(p, weights=times[q], minlength=len(ids)).astype(np.int64) + np.bincount(q, weights=times[p], minlength=len(ids)).astype(np.int64)
            if len(p):
                # Star edges of what is found so far: fewer than the rows, however many links there are.
                a, b = local_components(np.concatenate([a, p]), np.concatenate([b, q]))
        some = np.flatnonzero(links)
        return pa.table({"a": np.concatenate([ids[some], ids[a]]), "n": np.concatenate([links[some], np.zeros(len(a), np.int64)]), "b": np.concatenate([ids[some], ids[b]])})

    found = save(blocked.select("node", "unit", "home", "visits", "own", "times", "label", "cell", F.col("pair.x").alias("x"), F.col("pair.y").alias("y")).groupBy("label", "cell", "x", "y").applyInArrow(compare, "a long, n long, b long"))
    edges = found.select("a", "b")
    # The class of every entry; of most entries it is theirs alone.
    named = save(entries.join(classes.select("label", "digest", "node", "times"), ["label", "digest"]).select("vec_id", "node", "times"))
    several = save(named.groupBy("vec_id").agg(F.count("*").alias("k"), F.min("node").alias("first")).where("k > 1"))
    some = bool(several.limit(1).count())
    if some:  # ids with several vectors join the classes of these
        edges = edges.union(named.join(several, "vec_id").select(F.col("node").alias("a"), F.col("first").alias("b")))
    comp = components(edges)
    comp = save(comp.union(comp.select("root", "root").distinct()))
    low = classes.select("node", "low").join(comp, "node").groupBy("root").agg(F.min("low").alias("component_id"))
    sums = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    told = classes.select("node", "low").join(sums, "node", "left").join(comp.join(low, "root").select("node", "component_id"), "node", "left")
    # Written, so that the join with all members of a frequent vector can be split or broadcast.
    told = save(told.select("node", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component_id", "low").alias("component_id")))
    each = named.join(told, "node").select("vec_id", (F.col("n") + F.col("times") - 1).alias("n"), "component_id")
    if some:
        x = named.join(several, "vec_id").join(classes.select("node", "unit", "label"), "node").select("vec_id", "node", "unit", "label")
        y = x.select("vec_id", F.col("node").alias("other"), F.col("unit").alias("unit_y"), F.col("label").alias("label_y"))
        own_links = x.join(y, "vec_id").where("node <> other and label = label_y").select("vec_id", "unit", "unit_y").mapInArrow(_own_links(cosine), "vec_id long, n long")
        each = each.union(own_links.select("vec_id", -F.col("n"), F.lit(None).cast("long")))
        each = each.groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("component_id").alias("component_id"))
    out = all_ids.join(each.withColumnRenamed("vec_id", "known"), F.col("vec_id") == F.col("known"), "left")
    root = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(True)).alias("kept"))


def _own_links(cosine: float):
    """Links between the vectors of one id, from either side."""

    def run(batches):
        for batch in batches:
            s = np.einsum("ij,ij->i", as_matrix(batch.column(1)), as_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((s >= cosine).astype(np.int64))], ["vec_id", "n"])

    return run
