"""Quantiles of groups and running sums against numpy, and collisions on a grid against the plain rule."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillet.operators import layout, quantiles, weighted


@pytest.mark.parametrize("inside", [40, 100_000])
def test_quantiles_of_groups(spark, inside):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.standard_normal(6000)] + [("ties", float(x)) for x in rng.integers(0, 3, 3000)] + [("one", 5.0)] + [("none", None)] * 3
    rows += [(None, float(x)) for x in rng.exponential(1e6, 500)] + [("ends", float("inf")), ("ends", float("-inf")), ("ends", 1.0), ("hot", None), ("hot", float("nan"))] + [("same", 7.0)] * 400
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit(1)).withColumn("p", F.lit("x")).withColumn("lo", F.lit(2)).repartition(5)
    points = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in quantiles.grouped_quantiles(df, ["g"], "v", points, inside).collect()}
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    del groups["ends"]
    for g, v in groups.items():
        for p in points:
            assert got.pop((g, p)) == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)
    assert {k: got[k] for k in (("ends", 0.0), ("ends", 0.5), ("ends", 1.0))} == {("ends", 0.0): float("-inf"), ("ends", 0.5): 1.0, ("ends", 1.0): float("inf")}
    assert {k[0] for k in got} == {"ends"}
    whole = {r["p"]: r["value"] for r in quantiles.grouped_quantiles(df.where("g = 'hot'"), [], "v", points, inside).collect()}
    assert whole == pytest.approx({p: np.quantile(groups["hot"], p) for p in points})
    assert quantiles.grouped_quantiles(df.limit(0), ["g"], "v", points, inside).count() == 0


def test_running_sums_over_many_ranges(spark):
    rng = np.random.default_rng(2)
    x, w = np.round(rng.exponential(10, 5000), 1), rng.integers(0, 9, 5000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "w": w})).repartition(6)
    got = weighted.cumulative(df, "x", "w").orderBy("x").toPandas()
    sums = pd.Series(w[w > 0]).groupby(x[w > 0]).sum()
    assert np.array_equal(got["x"], sums.index) and np.allclose(got["cum"], sums.cumsum()) and set(got["total"]) == {w.sum()}
    assert weighted.cumulative(df.where("w < 0"), "x", "w").count() == 0


def test_places_of_rings(spark):
    k = spark.range(11 * 11).select(F.col("id").alias("k"))
    got = [(r["x"], r["y"]) for r in k.select("k", *(c.alias(n) for c, n in zip(layout.ring_place(F.col("k")), "xy", strict=True))).orderBy("k").collect()]
    assert got == [(dx, dy) for ring in range(6) for dx in range(-ring, ring + 1) for dy in range(-ring, ring + 1) if max(abs(dx), abs(dy)) == ring]


@pytest.mark.parametrize("kind", ["one tile", "tiles", "crowded tile"])
def test_collisions_in_parallel_equal_the_plain_rule(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    n, g = {"one tile": (300, 24), "tiles": (50, 14), "crowded tile": (14, 12)}[kind]
    if kind != "one tile":
        monkeypatch.setattr(layout, "TILE", 3)
    if kind == "crowded tile":
        monkeypatch.setattr(layout, "POINTS", 5)
    at = {"one tile": rng.integers(8, 12, (n, 2)), "tiles": rng.integers(2, 7, (n, 2)), "crowded tile": np.full((n, 2), 4)}[kind]
    cells = pd.DataFrame({"id": rng.permutation(5000)[:n], "gx": at[:, 0], "gy": at[:, 1], "g": g})
    want = {r.id: (r.gx, r.gy) for r in layout.spiral_free(cells).itertuples()}
    got = {r["id"]: (r["gx"], r["gy"]) for r in layout.collision_free(spark.createDataFrame(cells)).collect()}
    assert got == want and len(set(got.values())) == n


def test_crowded_borders_of_tiles_take_few_rounds(spark, monkeypatch):
    tables, plain = [], layout.written

    def counted(df):
        tables.append(df.columns)
        assert len(tables) <= 31, "over ten rounds of three tables"
        return plain(df)

    monkeypatch.setattr(layout, "written", counted)
    monkeypatch.setattr(layout, "TILE", 8)
    rng = np.random.default_rng(8)
    n, g = 800, 34
    at = np.clip(np.rint(rng.normal(16, 3, (n, 2))), 2, g - 3).astype(int)
    cells = pd.DataFrame({"id": rng.permutation(5000)[:n], "gx": at[:, 0], "gy": at[:, 1], "g": g})
    want = {r.id: (r.gx, r.gy) for r in layout.spiral_free(cells).itertuples()}
    got = {r["id"]: (r["gx"], r["gy"]) for r in layout.collision_free(spark.createDataFrame(cells)).collect()}
    assert got == want and len(set(got.values())) == n


@pytest.mark.parametrize(("n", "g"), [(600, 31), (60, 7)])
def test_crowds_of_many_tasks_take_batches_of_ids(spark, monkeypatch, n, g):
    tables, plain = [], layout.written

    def counted(df):
        tables.append(df.columns)
        assert len(tables) <= 14, "more tables than batches of ids and rounds over tiles"
        return plain(df)

    monkeypatch.setattr(layout, "written", counted)
    monkeypatch.setattr(layout, "TILE", 3)
    monkeypatch.setattr(layout, "POINTS", n // 6)
    rng = np.random.default_rng(9)
    at = np.clip(np.rint(rng.normal(g / 2, g / 9, (n, 2))), 0, g - 1).astype(int)
    cells = pd.DataFrame({"id": rng.permutation(5000)[:n] - 2000, "gx": at[:, 0], "gy": at[:, 1], "g": g})
    want = {r.id: (r.gx, r.gy) for r in layout.spiral_free(cells).itertuples()}
    got = {r["id"]: (r["gx"], r["gy"]) for r in layout.collision_free(spark.createDataFrame(cells)).collect()}
    assert got == want and len(set(got.values())) == min(n, g * g)


def test_points_without_a_free_cell_stay(spark):
    cells = pd.DataFrame({"id": range(6), "gx": [0, 0, 0, 1, 1, 0], "gy": [0, 0, 0, 1, 1, 0], "g": 2})
    want = {r.id: (r.gx, r.gy) for r in layout.spiral_free(cells).itertuples()}
    assert {r["id"]: (r["gx"], r["gy"]) for r in layout.collision_free(spark.createDataFrame(cells)).collect()} == want
    assert layout.collision_free(spark.createDataFrame(cells).limit(0)).count() == 0


@pytest.mark.parametrize("method", ["mds", "tsne"])
def test_layouts_of_whole_catalogues_keep_neighbourhoods(spark, method):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12)) * 4
    label = rng.integers(0, 6, 700)
    x = centres[label] + rng.standard_normal((700, 12)) * 0.5
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(700, None), (701, [1.0]), (702, [float("nan")] * 12), (None, [1.0] * 12)], "id long, embedding array<double>").repartition(3)
    got = layout.whole_layout(df, "id", "embedding", method, landmarks=90).orderBy("id").toPandas()
    assert got["id"].tolist() == list(range(700)) and np.isfinite(got[["x", "y"]]).all(axis=None)
    z = got[["x", "y"]].to_numpy()
    d = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :10]
    assert (label[near] == label[:, None]).mean() >= 0.9  # of random places about a sixth
    # Landmarks alone are solved as a small set is.
    few = df.where("id < 40")
    whole = layout.whole_layout(few, "id", "embedding", method).orderBy("id").toPandas()
    small = (layout.mds if method == "mds" else layout.tsne)(x[:40])
    assert np.allclose(whole[["x", "y"]], small)
    assert layout.whole_layout(df.limit(0), "id", "embedding", method).count() == 0


def test_layouts_are_kept_as_a_versioned_table(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0, float(i * i % 7)]) for i in range(30)], "id long, embedding array<double>")
    first = layout.Projections(f"file://{tmp_path}/layouts")
    one = first.get(df, "1").orderBy("id").collect()
    other = layout.Projections(f"file://{tmp_path}/layouts")  # another driver finds it
    assert other.get(df.limit(0), "1").orderBy("id").collect() == one and other.get(df.limit(0), "2").count() == 0
    assert other.get(df, "1", 3).columns == ["id", "x", "y", "z"]
    first.invalidate()
    assert first.get(df.limit(3), "1").count() == 3 and other.get(df, "1").count() == 30
