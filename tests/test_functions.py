import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillet.encoder import HashingEncoder, encoder_udf
from quillet.functions import text as tx
from quillet.functions import distance
from quillet.functions.distance import keyboard, weighted
from quillet.operators import features, fuzzy, layout, retrieval, weighted as wt
from quillet.sources import readers, sinks
from quillet.streaming import jobs


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@given(st.text("abcd é", max_size=8), st.text("abcd é", max_size=8))
@settings(max_examples=200, deadline=None)
def test_weighted_distance_is_symmetric_and_zero_iff_equal(a, b):
    assert math.isclose(weighted(a, b), weighted(b, a), abs_tol=1e-9)
    assert (weighted(a, b) == 0) == (a == b)


def test_weighted_distance_costs():
    assert weighted("amro", "amor") == 0.5
    assert weighted("esta", "està") == pytest.approx(0.1)
    assert weighted("ab", "a b") == 2.0
    assert weighted("abcdef", "uvwxyz", 1.0) == 2.0
    assert keyboard("a", "s") == 0.6 and keyboard("q", "p") == 1.0 and keyboard("a", "!") == 1.0


def test_normalize(spark):
    assert one(spark, "  Boooom l’Ametl.la ", tx.normalize) == "boom l'ametl·la"
    assert one(spark, "Cançó Enciclopèdia col·legi", tx.for_match) == "canco enciclopedia collegi"
    assert one(spark, "l'amor d'un a x", tx.tokens) == ["amor", "un", "a"]


@pytest.mark.parametrize(
    "url, want",
    [("https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1", "dQw4w9WgXcQ"), ("youtu.be/dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://youtube.com/embed/dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://youtube.com/shorts/dQw4w9WgXcQ", "dQw4w9WgXcQ"),
     ("https://www.youtube-nocookie.com/embed/dQw4w9WgXcQ", "dQw4w9WgXcQ"), (" dQw4w9WgXcQ ", "dQw4w9WgXcQ"), ("https://example.com/", None), ("", None), (None, None)],
)
def test_video_id(spark, url, want):
    assert one(spark, url, tx.video_id) == want


def test_budget_and_duration(spark):
    assert [one(spark, n, tx.edit_budget, "int") for n in (3, 5, 9, 13, 14)] == [0, 1, 2, 3, 4]
    assert [one(spark, n, tx.duration_text, "long") for n in (5, 65, 3665)] == ["5s", "1m 5s", "1h 1m 5s"]


@pytest.mark.parametrize("n, want", [(50, 15), (15, 5), (5, 2), (1, 1)])
def test_survivor_counts(spark, n, want):
    raw = spark.createDataFrame([(i, float(i) ** 1.1) for i in range(n)], "id long, raw double")
    assert retrieval.survivors(raw).count() == want


def test_zero_vector_and_lookup(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "id long, embedding array<double>")
    got = retrieval.neighbours(rows, 1, 2).orderBy(F.desc("score"), "id").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert [r["id"] for r in retrieval.ordered_lookup(rows, [3, 1, 3, 9], "id").orderBy("pos").collect()] == [3, 1, 3]


def test_weighted_percentiles_are_monotone(spark):
    df = spark.createDataFrame([(float(x), float(w)) for x, w in zip(range(20), itertools.cycle([1, 3, 2]))], "x double, w double")
    got = [r["value"] for r in wt.percentiles(df, "x", "w", [i / 10 for i in range(11)]).orderBy("p").collect()]
    assert got == sorted(got) and got[0] == 0.0 and got[-1] == 19.0


def test_layouts():
    x = np.random.default_rng(0).standard_normal((12, 8))
    z = layout.mds(x)
    assert z.shape == (12, 2) and np.isfinite(z).all() and layout.mds(x[:1]).tolist() == [[0.0, 0.0]]
    t = layout.tsne(x, rounds=60)
    assert t.shape == (12, 2) and np.isfinite(t).all()
    cells = layout.spiral_free(pd.DataFrame({"id": range(9), "gx": 5, "gy": 5}))
    assert len(set(zip(cells.gx, cells.gy))) == 9


def test_snap_has_no_displacement(spark):
    p = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(5)], "id long, x double, y double")
    old = spark.createDataFrame([(1, 3.0, 1.0), (2, 2.0, 2.0)], "id long, px double, py double")
    got = {r["id"]: (r["x"], r["y"]) for r in layout.rotate_and_snap(p, old, 0).collect()}
    assert got[1] == (3.0, 1.0) and got[2] == (2.0, 2.0)


def test_features(spark):
    m = {"Rock---Indie": 0.5, "Rock---Punk": 0.3, "Pop---X": 0.6}
    row = spark.createDataFrame([(m,)], "m map<string, double>").select(features.parents(F.col("m")).alias("p"), features.top_json(F.col("m"), 2).alias("t"), features.arg_max(F.col("m")).alias("a")).first()
    assert row["p"]["Rock"] == pytest.approx(0.8) and row["a"] == "Pop---X" and row["t"].startswith('{"Pop---X"')
    w = spark.createDataFrame([([1.0, 2.0],)], "a array<double>").select(features.windows(F.col("a"), 4, 2).alias("w")).first()["w"]
    assert w == [[1.0, 2.0, 0.0, 0.0]]


def test_robust_csv_and_urls(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("﻿Title,Sessions\n# note\n\nA,3\nB,x\nGrand total\n\"C, d\",4\n", encoding="utf-8")
    got = readers.robust_csv(spark, str(f), ["title", "sessions"]).withColumn("n", F.col("sessions").try_cast("double")).dropna(subset=["n"])
    assert sorted((r["title"], r["n"]) for r in got.collect()) == [("A", 3.0), ("C, d", 4.0)]
    u = tmp_path / "u.txt"
    u.write_text("# c\n\nhttps://youtu.be/dQw4w9WgXcQ\nhttps://example.com/\n")
    assert readers.url_list(spark, str(u)).count() == 2
    assert spark.createDataFrame([("['a', \"it's\"]",), ("oops",)], "x string").select(readers.literal_lists(F.col("x")).alias("l")).collect()[1]["l"] == []


def test_lexicon_and_sinks(spark, tmp_path):
    words = spark.createDataFrame([("amor", 1e-4), ("x", 1e-2), ("mes", 1e-3), ("raresa", 1e-9)], "word string, p double")
    got = {r["word"]: r["freq"] for r in readers.lexicon(words, blacklist=tx.BLACKLIST, seeds={"de": 1000, "amor": 5}).collect()}
    assert got == {"amor": 100, "de": 1000}
    sinks.csv(words, str(tmp_path / "c"))
    sinks.mark_processed(words.withColumnRenamed("word", "youtube_id"), str(tmp_path / "state"))
    left = jobs.unprocessed(spark.createDataFrame([("amor",), (None,), ("nou",), ("nou",)], "youtube_id string"), spark.read.parquet(str(tmp_path / "state")), "youtube_id")
    assert left.count() == 3


def test_word_bag_finds_swapped_letters(spark):
    q = spark.createDataFrame([("amro",)], "query string")
    titles = spark.createDataFrame([("boig per tu", 1)], "phrase string, freq long")
    lexicon = spark.createDataFrame([("amor", 400), ("dia", 10)], "phrase string, freq long")
    assert "amor" in {r["word"] for r in fuzzy.word_bag(q, titles, lexicon).collect()}


def test_encoder(spark):
    v = HashingEncoder(64).encode("Boig per tu")
    assert len(v) == 64 and np.linalg.norm(v) == pytest.approx(1, abs=1e-5)
    assert len(spark.createDataFrame([("a b",)], "x string").select(encoder_udf()("x").alias("v")).first()["v"]) == 384


def test_weighted_distances_of_many_pairs_equal_single_ones():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcàe pqr·ñ"), rng.integers(0, 9))) for _ in range(120)]
    pairs = [(words[i], words[j]) for i, j in rng.integers(0, len(words), (900, 2))] + [("", ""), ("ab", "ba"), ("日本", "日")]
    for cap in (float("inf"), 4.0, 1.5):
        got = distance.weighted_pairs(pairs, cap)
        assert got.tolist() == [distance.weighted(a, b, cap) for a, b in pairs]
    assert distance.weighted_pairs([]).tolist() == []
